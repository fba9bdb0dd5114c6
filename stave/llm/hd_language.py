"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. An n-gram is the
product of its letters' vectors, each rolled by its distance to the n-gram's end; a text
is the sum of its n-grams' vectors, a language the sum of its texts. The language whose
vector has the greatest cosine with the text's is predicted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.rolling import documents, mix

DIMENSIONS = 512
GRAM = 3
_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for anything else."""
    if "table" not in _letters:
        table = np.zeros(1 << 16, np.uint32)
        for code in range(1 << 16):
            if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
                table[code] = ord(chr(code).lower()[0])
        _letters["table"] = table
    return _letters["table"]


def code_points(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a slice of texts and the bounds of its rows in them."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes, heads[bounds]


def letters_of(codes: np.ndarray) -> np.ndarray:
    table = _letter_table()
    out = table[np.minimum(codes, 0xFFFF)]
    far = codes > 0xFFFF
    if far.any():
        kinds, place = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in kinds], np.uint32)[place]
    return out


def gram_counts(raw: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram number, count) ordered by row, and the letters of each gram number.

    A run of other characters counts as one blank; each row starts with a blank. A row with
    a letter but fewer than n symbols ends with blanks, so that it has a gram as well.
    """
    codes, at = code_points(raw, bounds)
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    letters = letters_of(codes)
    keep = letters > 0
    keep[1:] |= (letters[:-1] > 0) & (row[1:] == row[:-1])
    letters, row = letters[keep], row[keep]
    first = np.searchsorted(row, np.arange(rows))
    filled = first < np.searchsorted(row, np.arange(rows), "right")
    letters, row = np.insert(letters, first[filled], 0), np.insert(row, first[filled], np.arange(rows)[filled])
    last = np.searchsorted(row, np.arange(rows), "right")
    short = np.where(filled, np.maximum(0, n - (last - np.searchsorted(row, np.arange(rows)))), 0)
    letters, row = np.insert(letters, np.repeat(last, short), 0), np.insert(row, np.repeat(last, short), np.repeat(np.arange(rows), short))
    alphabet, letter = np.unique(letters, return_inverse=True)
    size, count = len(alphabet), len(letters) - n + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, n), np.uint32)
    gram = np.zeros(count, np.int64)
    for i in range(n):
        gram = gram * size + letter[i: i + count]
    whole = row[:count] == row[n - 1:]
    key = np.sort(row[:count][whole] * size ** n + gram[whole])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    lead = np.flatnonzero(new)
    number, place = np.unique(key[lead] % size ** n, return_inverse=True)
    spelled = np.stack([alphabet[number // size ** (n - 1 - i) % size] for i in range(n)], axis=1) if len(number) else np.zeros((0, n), np.uint32)
    return key[lead] // size ** n, place, np.diff(np.append(lead, len(key))), spelled


def gram_vectors(spelled: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams: the product of the rolled vectors of their letters."""
    n = spelled.shape[1]
    alphabet, place = np.unique(spelled, return_inverse=True)
    place = place.reshape(spelled.shape)
    seeds = mix(alphabet.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(dimensions, dtype=np.uint64)[None, :]
    signs = 1 - 2 * (mix(seeds) >> np.uint64(63)).astype(np.int8)
    bound = np.ones((len(spelled), dimensions), np.int8)
    for i in range(n):
        bound *= np.roll(signs, n - 1 - i, axis=1)[place[:, i]]
    return bound


def _bundle(n: int, dimensions: int) -> Callable:
    """The sum of the text vectors of each language of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("_lang").to_pylist()
            for a, b, raw, bounds in documents(batch, "_text"):
                row, gram, count, spelled = gram_counts(raw, bounds, n)
                if not len(row):
                    continue
                kinds, lang = np.unique(np.array(names[a:b], object), return_inverse=True)
                table = np.zeros((len(kinds), len(spelled)), np.int64)
                np.add.at(table, (lang[row], gram), count)
                bundled = table.astype(np.float64) @ gram_vectors(spelled, dimensions).astype(np.float64)
                for kind, vector in zip(kinds, bundled):
                    sums[kind] = sums.get(kind, 0) + vector.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["_lang", "_sums"])

    return run


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", n: int = GRAM, dimensions: int = DIMENSIONS) -> dict[str, list[int]]:
    """The bundled vector of each language of labelled rows; rows without text or language count for nothing.

    Languages are a closed set, so what reaches the driver is one short vector for each.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    parts = rows.mapInArrow(_bundle(n, dimensions), "_lang string, _sums array<long>")
    sums = parts.select("_lang", F.posexplode("_sums").alias("i", "v")).groupBy("_lang", "i").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_sums"))
    return {r["_lang"]: [x["v"] for x in r["_sums"]] for r in vectors.collect()}


def _compare(known: dict[str, list[int]], n: int, dimensions: int) -> Callable:
    names = sorted(known)
    table = np.array([known[x] for x in names], np.float64).reshape(len(names), dimensions)
    lengths = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.where(lengths > 0, lengths, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, bounds in documents(batch, "_text"):
                row, gram, count, spelled = gram_counts(raw, bounds, n)
                vectors = gram_vectors(spelled, dimensions).astype(np.float32)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                best, score = np.full(b - a, -1), np.zeros(b - a)
                for i in np.flatnonzero(np.diff(cut)) if names else ():
                    part = slice(cut[i], cut[i + 1])
                    text = (count[part].astype(np.float32) @ vectors[gram[part]]).astype(np.float64)
                    length = np.linalg.norm(text)
                    cosines = table @ text / length if length else np.zeros(len(names))
                    best[i] = int(np.argmax(cosines))
                    score[i] = min(1.0, max(0.0, cosines[best[i]]))
                lang = pa.array([names[x] if x >= 0 else "und" for x in best], pa.string())
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + [lang, pa.array(score)], [*batch.schema.names[:-1], "_lang_pred", "_score"])

    return run


def identify(docs: DataFrame, known: dict[str, list[int]], text_col: str = "text", n: int = GRAM, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (the cosine, 0 to 1) in place of any columns of these names.

    A null text, one without a letter, or any text where no language is known is ``und``
    with score 0; of equal cosines the first language in order wins. All of a text counts.
    """
    rest = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    out = rest.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(_compare(known, n, dimensions), f"{fields}, _lang_pred string, _score double")
    return out.withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"})


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of learning: CRC-32 of the id as text is 1 modulo 3 (a null id always is)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op9_hd_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), known).drop("text")
