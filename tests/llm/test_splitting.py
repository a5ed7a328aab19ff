"""Splitting: limits, overlap, natural ends, lines, and the odd rows."""

from hypothesis import given, settings
from hypothesis import strategies as st

from intentlake.llm.splitting import boundaries, cut_points, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .;\n\r\tß🚀", max_size=400), st.integers(1, 60), st.integers(-5, 80))
def test_pieces_cover_the_text(text, size, overlap):
    pieces = cut_points(text, size, overlap)
    wanted = min(max(0, overlap), size - 1)
    assert ("".join(text[s + (wanted if i else 0) : e] for i, (s, e) in enumerate(pieces))) == text
    assert all(0 < e - s <= size for s, e in pieces)
    for (_, e), (s, _) in zip(pieces, pieces[1:]):
        assert s == e - wanted


def test_ends_are_natural():
    text = "def a():\n    return 1\n\ndef b():\n    return 2\n\ndef c():\n    return 3\n"
    pieces = cut_points(text, 50, 0)
    assert [text[s:e] for s, e in pieces][0].endswith("\n\n")
    assert all(text[e - 1] == "\n" for _, e in pieces)
    words = "one two three four five six seven eight nine ten"
    assert all(e == len(words) or words[e] == " " or words[e - 1] == " " for _, e in cut_points(words, 12, 3))


def test_hard_cut_and_line_ends():
    assert cut_points("x" * 25, 10, 4) == [(0, 10), (6, 16), (12, 22), (18, 25)]
    text = "a" * 9 + "\r\n" + "b" * 9
    assert all(not (text[e - 1] == "\r" and text[e : e + 1] == "\n") for _, e in cut_points(text, 10, 0))


def test_boundaries_are_sorted():
    ends, levels = boundaries("a; b\n\n  c.d e\nf")
    assert list(ends) == sorted(ends) and set(levels) <= {0, 1, 2, 3}


def test_operator(spark):
    long = "\n".join(f"line {i} of the text" for i in range(60))
    chunks = spark.createDataFrame(
        [(1, "r", long, 10, "x", 5), (1, "r", long, 10, "y", 6), (2, "none", "z" * 1501, None, None, 1), (3, "r", None, 1, "a", 1), (4, "r", "", 1, "a", 1), (5, None, "z" * 1500, 1, "a", 1), (6, "dflt", "🚀" * 1500, 1, "a", 1), (7, "tiny", "abc", 1, "a", 1)],
        "chunk_id bigint, repo string, content string, start_line bigint, _size string, chunk_size int",
    )
    params = spark.createDataFrame([("r", 200, 30, 1), ("r", 300, 30, 1), ("dflt", None, None, 1), ("tiny", 0, 5, 1), (None, 3, 1, 1)], "repo string, chunk_size bigint, overlap_chars bigint, content int")
    rows = split_oversized(chunks, params).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in rows} == {1, 2, 7}
    one = [r for r in rows if r.chunk_id == 1]
    assert all(len(r.content) <= 200 and r.content == long[r.char_start : r.char_end] and r.n_pieces == len(one) for r in one)
    assert all(b.char_start == a.char_end - 30 for a, b in zip(one, one[1:]))
    for r in one:
        assert r.start_line == 10 + long[: r.char_start].count("\n")
        assert r.end_line == 10 + long[: r.char_end - 1].count("\n")
    assert [len(r.content) for r in rows if r.chunk_id == 2] == [1500, 1]
    assert [r.content for r in rows if r.chunk_id == 7] == ["a", "b", "c"]
    assert split_oversized(chunks.limit(0), params).count() == 0
    assert split_oversized(chunks, params.limit(0)).count() == 2
