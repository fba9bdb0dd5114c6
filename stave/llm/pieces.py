"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi.

The automaton holds all pieces. As it reads a text, the state's output links name every
piece that ends at the position, and each relaxes the best score there. No piece has a
blank after another character, so a text falls apart into chunks (blanks, then a word)
whose best paths are independent: the different chunks of a slice of texts are read in
step, position by position, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.hd_language import code_points
from stave.llm.rolling import Rolling, documents, mix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_built: list[tuple[Pieces, Automaton]] = []


@dataclass(frozen=True)
class Pieces:
    """The vocabulary: spelling and score of each piece; the numbers of the pieces that stand for a byte."""

    spelled: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    bytes_at: tuple[int, ...]


def load_pieces(path: str = MODEL_PATH) -> Pieces:
    """Read a model file. It needs byte pieces, and no piece with a blank behind another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = tuple(not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size))
    spelled = tuple(model.id_to_piece(i) for i in range(size))
    if any(p and BLANK in s.lstrip(BLANK) for s, p in zip(spelled, plain)):
        raise ValueError("a piece continues behind a blank")
    bytes_at = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    if not all(model.is_byte(i) for i in bytes_at):
        raise ValueError("the model has no byte pieces")
    return Pieces(spelled, tuple(model.get_score(i) for i in range(size)), plain, bytes_at)


class Automaton:
    """Transitions over classes of characters, and for each state the pieces that end there, longest first."""

    def __init__(self, pieces: Pieces):
        used = [(i, s) for i, (s, p) in enumerate(zip(pieces.spelled, pieces.plain)) if p and s]
        long = sorted({c for _, s in used for c in s if len(s) > 1} | {BLANK})
        self.classes = {c: k for k, c in enumerate(long)}
        children: list[dict[int, int]] = [{}]
        depth, piece = [0], [-1]
        self.single: dict[int, int] = {}
        for i, s in used:
            if len(s) == 1:
                self.single[ord(s)] = i
            if any(c not in self.classes for c in s):
                continue
            at = 0
            for c in s:
                k = self.classes[c]
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                at = children[at][k]
            piece[at] = i
        n = len(children)
        self.move = np.zeros((n, len(long) + 1), np.int32)
        self.next_out = np.full(n, -1, np.int32)
        self.piece, self.depth = np.array(piece, np.int32), np.array(depth, np.int32)
        fail, order = np.zeros(n, np.int32), [0]
        for at in order:
            back = fail[at]
            if at:
                self.move[at] = self.move[back]
                self.next_out[at] = back if piece[back] >= 0 else self.next_out[back]
            for k, child in children[at].items():
                fail[child] = self.move[at, k] if at else 0
                self.move[at, k] = child
                order.append(child)
        self.first_out = np.where(self.piece >= 0, np.arange(n, dtype=np.int32), self.next_out)
        self.score = np.array([pieces.scores[i] if i >= 0 else 0.0 for i in piece])
        plain = [s for s, p in zip(pieces.scores, pieces.plain) if p]
        self.unknown = min(plain, default=0.0) - 10.0
        self.scores = np.array(pieces.scores)
        self.bytes_at = np.array(pieces.bytes_at, np.int32)
        table = np.full(1 << 16, len(long), np.int32)
        for c, k in self.classes.items():
            table[ord(c)] = k
        table[ord(BLANK)], table[0x20] = len(long), self.classes[BLANK]
        lone = np.full(1 << 16, -1, np.int32)
        for c, i in self.single.items():
            if c < 1 << 16:
                lone[c] = i
        lone[0x20], lone[ord(BLANK)] = self.single.get(ord(BLANK), -1), -1
        self.table, self.lone = table, lone

    def read(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and lone piece (or -1) of each code point; a blank character in the text itself is unknown."""
        near = np.minimum(codes, 0xFFFF)
        kind, lone = self.table[near], self.lone[near]
        far = np.flatnonzero(codes > 0xFFFF)
        if len(far):
            kind[far] = len(self.classes)
            lone[far] = [self.single.get(int(c), -1) for c in codes[far]]
        return kind, lone

    def best(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best path of each chunk codes[at[i]:at[i + 1]]: its ids, and their bounds.

        Of paths with equal scores the one whose last piece is longest wins, at each position.
        """
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        start, size = at[:-1][order], size[order]
        kind, lone = self.read(codes)
        base = start + order  # each chunk has one more position than characters
        score = np.full(len(codes) + len(order), -np.inf)
        score[base] = 0.0
        took, length = np.full(len(score), -1, np.int32), np.ones(len(score), np.int32)
        state = np.zeros(len(order), np.int32)
        longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for t, n in enumerate(longer):
            place, here = start[:n] + t, base[:n] + t + 1
            state = self.move[state[:n], kind[place]]
            best = np.full(n, -np.inf)
            out, who = self.first_out[state], np.arange(n)
            while True:
                some = out >= 0
                if not some.any():
                    break
                out, who = out[some], who[some]
                long = self.depth[out]
                reach = score[here[who] - long] + self.score[out]
                better = reach > best[who]
                won = who[better]
                best[won] = reach[better]
                took[here[won]], length[here[won]] = self.piece[out[better]], long[better]
                out = self.next_out[out]
            alone = lone[place]
            other = kind[place] == len(self.classes)
            fresh = np.flatnonzero(other | (alone < 0))
            if len(fresh):
                known = alone[fresh] >= 0
                reach = score[here[fresh] - 1] + np.where(known, self.scores[np.maximum(alone[fresh], 0)], self.unknown)
                better = reach > best[fresh]
                won = fresh[better]
                best[won] = reach[better]
                took[here[won]], length[here[won]] = np.where(known, alone[fresh], -2)[better], 1
            score[here] = best
        return self._path(codes, start, base, size, order, took, length)

    def _path(self, codes, start, base, size, order, took, length) -> tuple[np.ndarray, np.ndarray]:
        who, place = np.arange(len(order)), size.copy()
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = place > 0
        who, place = who[live], place[live]
        while len(who):
            here = base[who] + place
            ids, place = took[here], place - length[here]
            steps.append((who, place, ids))
            live = place > 0
            who, place = who[live], place[live]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(order) + 1, np.int64)
        who, place, ids = (np.concatenate(x) for x in zip(*steps))
        # Unknown characters become their UTF-8 bytes.
        code = codes[start[who] + place]
        wide = np.where(ids == -2, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        chunk = order[who]
        rank = np.lexsort((place, chunk))
        chunk, ids, code, wide = chunk[rank], ids[rank], code[rank], wide[rank]
        if (ids == -2).any():
            turn = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
            chunk, ids, code, many = (np.repeat(x, wide) for x in (chunk, ids, code, wide))
            head = np.select([many == 1, many == 2, many == 3], [0, 0xC0, 0xE0], 0xF0)
            bits = (code.astype(np.int64) >> (6 * (many - 1 - turn))) & np.where(turn > 0, 0x3F, 0x7F)
            ids = np.where(ids == -2, self.bytes_at[np.where(turn > 0, 0x80 | bits, head | bits)], ids)
        return ids.astype(np.int32), np.searchsorted(chunk, np.arange(len(order) + 1))


def automaton(pieces: Pieces) -> Automaton:
    """The automaton of a vocabulary; a worker keeps the last one, and knows it by all of the vocabulary."""
    if not _built or (_built[0][0] is not pieces and _built[0][0] != pieces):
        _built[:] = [(pieces, Automaton(pieces))]
    return _built[0][1]


def encode_slice(auto: Automaton, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each row of a slice and their bounds. A row that is not empty is read behind one more blank."""
    codes, at = code_points(raw, bounds)
    filled = np.diff(at) > 0
    codes = np.insert(codes, at[:-1][filled], 0x20)
    at = at + np.concatenate([[0], np.cumsum(filled)])
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    blank = codes == 0x20
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[at[:-1][filled]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(codes))
    marks = Rolling(mix(codes.astype(np.uint64) + np.uint64(1)), "byte").stretch(begin, end)
    _, lead, kind = np.unique(marks, return_index=True, return_inverse=True)
    size = end[lead] - begin[lead]
    bound = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(bound[-1]) + np.repeat(begin[lead] - bound[:-1], size)
    ids, path = auto.best(codes[index], bound)
    many = np.diff(path)[kind]
    total = np.concatenate([[0], np.cumsum(many)])
    index = np.arange(total[-1]) + np.repeat(path[kind] - total[:-1], many)
    return ids[index], total[np.searchsorted(begin, at)]


class Spelling:
    """The bytes of all pieces in one buffer, to spell ids by one gather."""

    def __init__(self, pieces: Pieces):
        whole = [s.replace(BLANK, " ").encode() if p else b"" for s, p in zip(pieces.spelled, pieces.plain)]
        for b, i in enumerate(pieces.bytes_at):
            whole[i] = bytes([b])
        self.size = np.array([len(x) for x in whole], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(whole), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a sequence of ids, and where each id's begin."""
        each = self.size[ids]
        total = np.concatenate([[0], np.cumsum(each)])
        return self.letters[np.arange(total[-1]) + np.repeat(self.start[ids] - total[:-1], each)], total


def spells(spelling: Spelling, ids: np.ndarray, at: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the ids of each row decode to its text."""
    data, total = spelling.bytes_of(ids)
    edges = total[at]
    out = np.zeros(len(bounds) - 1, bool)
    for i in range(len(out)):
        told = data[edges[i]: edges[i + 1]]
        told = told[1:] if len(told) and told[0] == 0x20 else told
        out[i] = np.array_equal(told, raw[bounds[i]: bounds[i + 1]])
    return out


def _encode(pieces: Pieces, checked: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, spelling = automaton(pieces), Spelling(pieces) if checked else None
        for batch in batches:
            for a, b, raw, bounds in documents(batch, "_text"):
                ids, at = encode_slice(auto, raw, bounds)
                made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                if checked:
                    made.append(pa.array(spells(spelling, ids, at, raw, bounds)))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + made, [*batch.schema.names[:-1], "_ids", "_same"][: batch.num_columns - 1 + len(made)])

    return run


def _decode(pieces: Pieces) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(pieces)
        for batch in batches:
            column = batch.column("_ids")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for a in range(0, len(column), 256):
                b = min(len(column), a + 256)
                data, total = spelling.bytes_of(values[offsets[a]: offsets[b]])
                data, at = data.tobytes(), total[offsets[a: b + 1] - offsets[a]]
                texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:])]
                texts = pa.array([t[1:] if t.startswith(" ") else t for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + [texts], [*batch.schema.names[:-1], "_decoded"])

    return run


def _typed(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with the piece ids of their texts in ``ids_col`` (array<int>, in place of a column of that name).

    The path with the greatest sum of piece scores is taken. Spaces are blanks, a text is
    read behind one more blank, characters without a piece become byte pieces, and so
    does the blank sign U+2581 itself, which keeps decoding exact. A null or empty text
    has no ids. Whole texts are read.
    """
    rest = docs.drop(ids_col)
    out = rest.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    return out.mapInArrow(_encode(pieces, False), f"{_typed(rest)}, _ids array<int>").withColumnRenamed("_ids", ids_col)


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in ``text_col``; null or no ids give an empty text, broken UTF-8 gives U+FFFD."""
    rest = encoded.drop(text_col)
    out = rest.withColumn("_ids", F.coalesce(F.col(ids_col), F.array().cast("array<int>"))).mapInArrow(_decode(pieces), f"{_typed(rest)}, _decoded string")
    return out.withColumnRenamed("_decoded", text_col)


def encoded(docs: DataFrame, pieces: Pieces, keep: list[str], text_col: str = "text") -> DataFrame:
    """Chosen columns, ``n_ids``, ``ids`` and ``round_trip``; the texts go to the tasks, but do not come back."""
    kind = f"{_typed(docs.select(*keep))}, _ids array<int>, _same boolean"
    out = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(_encode(pieces, True), kind)
    return out.select(*keep, F.size("_ids").alias("n_ids"), F.col("_ids").alias("ids"), F.col("_same").alias("round_trip"))


def op3_pieces(spark, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_pieces(model_path), ["doc_id"])
