"""Spam: features of texts of each kind, and the operator over a small crawl."""

import random
import time

import numpy as np

from intentlake.llm.spam import UNKNOWN, Measure, distinct_texts, function_words, spam_scores

SENTENCES = {
    "en": "The parser reads each of the files and writes them to the index. When a chunk is too large we cut it at a line that is blank.",
    "de": "Der Leser öffnet die Datei und schreibt den Abschnitt in den Index. Wenn ein Block zu groß ist, teilen wir ihn an einer leeren Zeile.",
    "fr": "Le lecteur ouvre le fichier et écrit la section dans le journal. Quand un bloc est trop grand on le coupe à une ligne vide.",
    "es": "El lector abre el archivo y escribe la sección en el registro. Cuando un bloque es muy grande se corta en una línea vacía.",
}
SPAM = [
    "cheap index " * 60,
    "\n".join(f"- [fast tool {i}](https://shop{i}.example/x?{i})" for i in range(20)),
    " ".join(f"#tag{c}" for c in "abcdefghijklmnopqrstuvwxyz"),
    "\n".join(f"SKU-{i} / red / XL / {i}.99" for i in range(30)),
    "".join(f'<a href="http://a{i}.example">best page</a> ' for i in range(25)),
]
FINE = [
    "\n".join(f"- The step {i} of this list is a sentence of its own." for i in range(12)),
    SENTENCES["en"] * 6 + "\nSources:\n" + "\n".join(f"[{i}] https://a.example/{i}" for i in range(4)),
    SENTENCES["en"] + "\n\n    x = f(1)\n    if x:\n        return x\n\n" + SENTENCES["en"],
]


TAUGHT = {
    "en": "the of and to a when is it at that them for an this its own".split(),
    "de": "der die das und den in wenn ein zu wir ihn an einer".split(),
    "fr": "le la et dans quand un est on de une trop".split(),
    "es": "el la y en cuando un es se una de muy".split(),
}
PROSE = {
    "ru": "Парсер читает каждый файл и записывает его в индекс. Когда блок слишком велик, мы разрезаем его на пустой строке. Пользователь задаёт размер окна, и программа хранит результат в журнале.",
    "zh": "解析器读取每个文件并将其写入索引。当一个块太大时，我们会在空行处切割它。用户可以指定窗口的大小，程序会把结果保存在日志中。搜索速度很快，因为索引保存在内存里。",
    "pl": "Parser czyta każdy plik i zapisuje go w indeksie. Gdy blok jest zbyt duży, dzielimy go w pustym wierszu. Użytkownik może podać rozmiar okna, a program zapisze wynik w dzienniku.",
    "sv": "Tolken läser varje fil och skriver den till indexet. När ett block är för stort delar vi det vid en tom rad. Användaren kan ange storleken, och programmet sparar resultatet i loggen.",
    "notes": "Fix race in cache writer\nAdd tests for tokenizer\nBump version to 1.4\nRemove dead code from parser\nUpdate docs\nHandle empty input in splitter",
}


def test_pushed_share():
    measure = Measure(TAUGHT)
    assert (measure(SPAM)[1][:, 0] > 0.6).all()
    assert (measure(FINE)[1][:, 0] < 0.4).all()
    languages, x = measure(list(SENTENCES.values()))
    assert languages == list(SENTENCES) and (x[:, 0] < 0.1).all()
    languages, x = measure(list(PROSE.values()))
    assert set(languages) == {UNKNOWN} and (x[:, 0] < 0.3).all()


def test_stuffing_between_function_words():
    rng = random.Random(2)
    text = " ".join("plate symbol " + " ".join(f"{rng.choice(('and', 'for', 'of', 'to'))} plate symbol" for _ in range(3)) + f" and {rng.choice(('quota', 'tenant', 'forest'))}." for _ in range(12))
    assert Measure(TAUGHT)([text])[1][0, 0] > 0.9


def test_odd_texts_take_linear_time():
    measure = Measure(TAUGHT)
    for text in ("", " ", "\n\n", "1234", "http://x", "日本語のテキスト", "a" * 100_000, "\x01\x02"):
        languages, x = measure([text])
        assert languages == [UNKNOWN] and x.shape == (1, 6) and np.isfinite(x).all()
    assert measure([])[0] == []
    for text in ("<a " * 100_000, '<a href="x" ' * 50_000, "[" * 100_000, "<" * 100_000, "." * 100_000 + "x", "[a](" * 50_000, "#" * 100_000):
        began = time.perf_counter()
        measure([text])
        assert time.perf_counter() - began < 3


def test_operator(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SENTENCES))
        parts = SENTENCES[lang].split(". ")
        rows.append((i, ". ".join(rng.choice(parts) for _ in range(rng.randrange(3, 9))) + ".", lang.upper() if i % 5 else None))
    rows += [(1000 + i, t, "en") for i, t in enumerate(SPAM * 3)] + [(2000 + i, t, None) for i, t in enumerate(FINE)]
    rows += [(3000, None, "en"), (3001, " \n ", "en"), (None, SPAM[0], "en"), (1000, SPAM[0], "en")]
    d = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id bigint, text string, lang string, distance double, x string")
    got = spam_scores(d).collect()
    assert {r.doc_id for r in got if r.is_spam} == {None, *range(1000, 1015)}
    assert {3000, 3001}.isdisjoint({r.doc_id for r in got}) and all(r.distance is not None for r in got)
    assert spam_scores(d.limit(0)).count() == 0
    assert spam_scores(d.where("doc_id = 1000")).count() == 2
    assert distinct_texts(d.where("doc_id is null or doc_id = 1000")).count() == 1


def test_prose_of_other_languages_is_not_spam(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        lang = rng.choice(list(SENTENCES))
        parts = SENTENCES[lang].split(". ")
        rows.append((i, ". ".join(rng.choice(parts) for _ in range(rng.randrange(3, 9))) + ".", lang))
    rows += [(1000 + i, t, lang if i % 2 else None) for i, (lang, t) in enumerate(PROSE.items())]
    rows += [(2000, "便宜索引购买" * 30, "zh"), (2001, SPAM[2], "sv")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in spam_scores(d).where("is_spam").collect()} == {2000, 2001}
    assert set(function_words(distinct_texts(d))) <= set(SENTENCES)


def test_spam_that_is_most_of_a_language_is_found(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 4 == 0]
        parts = SENTENCES[lang].split(". ")
        rows.append((i, ". ".join(rng.choice(parts) for _ in range(rng.randrange(3, 9))) + ".", lang))
    rows += [(1000 + i, "Suche billig kaufen Index " * 40, "de") for i in range(200)]
    rows += [(2000 + i, " ".join(f"{rng.choice(('outil', 'prix', 'achat'))} discount cher" for _ in range(60)), "fr") for i in range(40)]
    rows += [(3000, "barato índice comprar " * 50, "es")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in spam_scores(d).where("is_spam").collect()} == {*range(1000, 1200), *range(2000, 2040), 3000}
    assert {r.doc_id for r in spam_scores(d.where("doc_id >= 1000")).where("is_spam").collect()} == {*range(1000, 1200), *range(2000, 2040), 3000}
