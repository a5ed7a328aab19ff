"""Encoders: a vector for each text, from a column, by hashing, or by a static model."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlake.functions import vectors

#: Environment variable that names a model folder.
MODEL_VARIABLE = "INTENTLAKE_MODEL_PATH"
MODEL_FILES = ("config.json", "tokenizer.json", "model.safetensors")


WORD = re.compile("[a-z0-9]+")


class ColumnEncoder:
    """Vectors that are there already, normalised."""

    def __init__(self, column: str = "embedding") -> None:
        self.column = column

    def encode(self, df: DataFrame, text: str, to: str = "embedding") -> DataFrame:
        return df.withColumn(to, vectors.normalized(F.col(self.column)))


class HashEncoder:
    """Counts of the text's words in `width` hashed buckets, normalised; needs no model.

    Words are runs of a-z and 0-9 of the lower-cased text. A null or wordless
    text is a zero vector. A bucket is the first 32 bits of the word's MD5 hash
    modulo the width, as bucket() has it for SQL.
    """

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def bucket(self, word: Column) -> Column:
        return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % self.width

    def rows(self, texts: list[str | None]) -> np.ndarray:
        known: dict[str, int] = {}
        out = np.zeros((len(texts), self.width))
        for v, t in zip(out, texts, strict=True):
            for w in WORD.findall(t.lower()) if t is not None else ():
                b = known.get(w)
                if b is None:
                    b = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.width
                v[b] += 1
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(norm > vectors.LEAST_NORM, out / np.maximum(norm, vectors.LEAST_NORM), out)

    def encode(self, df: DataFrame, text: str, to: str = "embedding") -> DataFrame:
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(list(self.rows(list(part))))

        return df.withColumn(to, F.pandas_udf(run, "array<double>")(F.col(text)))

    def encode_one(self, text: str) -> list[float]:
        return self.rows([text])[0].tolist()


def is_model_dir(folder: str) -> bool:
    return all(os.path.isfile(os.path.join(folder, f)) for f in MODEL_FILES)


def cache_roots(env: Mapping[str, str]) -> list[str]:
    """Folders of the public hub's cache, the most specific first."""
    roots = []
    if env.get("HF_HUB_CACHE"):
        roots.append(env["HF_HUB_CACHE"])
    if env.get("HF_HOME"):
        roots.append(os.path.join(env["HF_HOME"], "hub"))
    if env.get("HOME"):
        roots.append(os.path.join(env["HOME"], ".cache", "huggingface", "hub"))
    return roots


def newest_snapshot(repo: str) -> str | None:
    """The snapshot last changed, of those that are whole."""
    folder = os.path.join(repo, "snapshots")
    if not os.path.isdir(folder):
        return None
    whole = [p for p in (os.path.join(folder, n) for n in os.listdir(folder)) if is_model_dir(p)]
    return max(whole, key=os.path.getmtime, default=None)


def resolve_model(name: str, env: Mapping[str, str] | None = None) -> str:
    """Folder of a model: the name itself if it is a folder, else the variable's if whole, else the newest cached snapshot. Never the network."""
    env = os.environ if env is None else env
    if os.path.isdir(name):
        return name
    looked = []
    if env.get(MODEL_VARIABLE):
        if is_model_dir(env[MODEL_VARIABLE]):
            return env[MODEL_VARIABLE]
        looked.append(env[MODEL_VARIABLE])
    for root in cache_roots(env):
        repo = os.path.join(root, "models--" + name.replace("/", "--"))
        found = newest_snapshot(repo)
        if found:
            return found
        looked.append(os.path.join(repo, "snapshots"))
    raise FileNotFoundError(f"Embedding model {name!r} not found locally. Looked in:\n" + "\n".join(f"  {x}" for x in looked))


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file: a length, a JSON header, the bytes."""
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4"}
    with open(path, "rb") as f:
        header = json.loads(f.read(struct.unpack("<Q", f.read(8))[0]))
        data = f.read()
    return {k: np.frombuffer(data[slice(*v["data_offsets"])], kinds[v["dtype"]]).reshape(v["shape"]) for k, v in header.items() if k != "__metadata__" and v["dtype"] in kinds}


class StaticModelEncoder:
    """Mean of a static model's token vectors, normalised; the table is sent to each executor once.

    Its size is that of the model, checked against `most_bytes`. Unknown tokens
    are left out; a text without tokens, or null, is a zero vector. All tokens
    of a text are pooled unless `most_tokens` names a limit.
    """

    def __init__(self, name: str, most_tokens: int | None = None, most_bytes: int = 1 << 30) -> None:
        self.folder = resolve_model(name)
        if os.path.getsize(os.path.join(self.folder, "model.safetensors")) > most_bytes:
            raise ValueError("the model's table is too large to send to the executors")
        self.most_tokens = most_tokens
        tensors = read_safetensors(os.path.join(self.folder, "model.safetensors"))
        self.table = next(t for t in tensors.values() if t.ndim == 2).astype(np.float32)
        with open(os.path.join(self.folder, "tokenizer.json"), encoding="utf-8") as f:
            self.tokenizer = f.read()
        with open(os.path.join(self.folder, "config.json"), encoding="utf-8") as f:
            self.normalize = bool(json.load(f).get("normalize", True))

    @property
    def dim(self) -> int:
        return self.table.shape[1]

    @staticmethod
    def pool(tokenizer, table: np.ndarray, texts: list[str], most: int | None) -> np.ndarray:
        out = np.zeros((len(texts), table.shape[1]), np.float32)
        tokenizer.no_truncation()  # a model's own file may set a limit
        unknown = tokenizer.token_to_id("[UNK]")
        for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids = [t for t in e.ids[:most] if t != unknown]
            if ids:
                out[i] = table[ids].mean(axis=0)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(norm > vectors.LEAST_NORM, out / np.maximum(norm, vectors.LEAST_NORM), out)

    def encode(self, df: DataFrame, text: str, to: str = "embedding") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.tokenizer, self.table))
        most = self.most_tokens
        pool = self.pool

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            tokenizer, table = Tokenizer.from_str(shared.value[0]), shared.value[1]
            for part in parts:
                yield pd.Series(pool(tokenizer, table, [t or "" for t in part], most).tolist())

        return df.withColumn(to, F.pandas_udf(run, "array<float>")(F.col(text)))

    def encode_one(self, text: str) -> list[float]:
        from tokenizers import Tokenizer

        return self.pool(Tokenizer.from_str(self.tokenizer), self.table, [text], self.most_tokens)[0].tolist()
