"""SentencePiece ids of whole texts from a table of last tokens, one for each prefix.

A BPE model of the library joins, again and again, the neighbours whose joined string is a piece of the best score (the
leftmost of equals). Two facts follow, whatever the scores are. Where no join crossed a place in the end, what is left
and right of it was joined as if it stood alone; so any neighbours ``a, b`` of an encoding are the encoding of ``ab``. And a
sequence of pieces whose neighbours are all compatible in this sense is an encoding, as the first join across one of its
borders would also have come first in its pair alone. So each prefix of a text has one last token: the one piece that ends
there (an Aho-Corasick automaton names them all) and is compatible with the last token of the prefix before it. One pass
forwards fills that table, one pass backwards reads the ids off it.

A pair is tested without joining its text anew: each piece keeps the order of its own joins and the symbols that they put
at its borders, and the two orders are merged until a join across the border would be next, or none is left.

Texts are cut where no piece has such neighbours (before a word's space, for one), and frequent parts are looked up.
The library itself normalises the text and decodes the ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from spindrift.llm.rows import unused
from spindrift.session import bound_batches

#: Parts (words) whose ids a task remembers, and the characters of the longest of them; pairs whose test it remembers.
PARTS, PART_CHARS, PAIRS = 300_000, 40, 1_000_000
#: The library's sign for a space (a fixed value).
SPACE = "\u2581"
#: Characters whose parts are learned together, about (a text is never split).
CHARS = 4 << 20


class Encoder:
    """The ids of texts by one model (a BPE model without user-defined or unused pieces)."""

    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a model with unused pieces")
        self.id = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {piece: sp.get_score(i) for piece, i in self.id.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else None
        self.unknown = sp.unk_id()

        self.joins: list[tuple[list, list]] = []  # of each token: a piece, or a character of pieces, that is its own encoding
        self.token: list[tuple[str, int | None]] = []
        # Aho-Corasick: steps of each state, its failure link, and the tokens that end in it, longest first
        self._steps: list[dict[str, int]] = [{}]
        self._ends: list[list[tuple[int, int]]] = [[]]
        chars = {c for piece in self.id for c in piece}
        for piece in sorted(chars.union(self.id)):
            steps = self._joined(piece)
            if steps is not None:
                self._add(piece, len(self.joins))
                self.joins.append(steps)
                self.token.append((piece, self.id.get(piece)))
        self._link()
        self._compatible: list[dict[int, bool]] = [{} for _ in self.joins]
        self._n_pairs = 0

        # a sign that stands in pieces only in front, after its own kind (a word's space): nothing reaches across it
        inner = {c for piece in self.id for before, c in zip(piece, piece[1:]) if before != c}
        self.sign = SPACE if SPACE not in inner else None
        self._part = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._known: dict[str, bytes] = {}

    def _add(self, piece: str, token: int) -> None:
        state = 0
        for c in piece:
            after = self._steps[state].get(c)
            if after is None:
                after = self._steps[state][c] = len(self._steps)
                self._steps.append({})
                self._ends.append([])
            state = after
        self._ends[state].append((len(piece), token))

    def _link(self) -> None:
        self._fail = [0] * len(self._steps)
        level = [*self._steps[0].values()]
        while level:
            below = []
            for state in level:
                for c, after in self._steps[state].items():
                    back = self._fail[state]
                    while back and c not in self._steps[back]:
                        back = self._fail[back]
                    self._fail[after] = self._steps[back].get(c, 0)
                    below.append(after)
            for state in below:
                self._ends[state] += self._ends[self._fail[state]]
            level = below

    def _step(self, state: int, c: str) -> int:
        """The state after a character that ``state`` has no step for; kept as a step of its own if the model knows the character."""
        back = state
        while back and c not in self._steps[back]:
            back = self._fail[back]
        after = self._steps[back].get(c, 0)
        if after:
            self._steps[state][c] = after
        return after

    def _joined(self, piece: str) -> tuple[list, list] | None:
        """The joins of a piece in their order, as ``score, symbol at its right border`` and the same for its left border; None if it is not its own encoding."""
        symbols, score = list(piece), self.score
        left, right = [(None, symbols[0])], [(None, symbols[-1])]
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            left.append((best, symbols[0]))
            right.append((best, symbols[-1]))
        return right, left

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of two tokens' joined text is these two."""
        if self._n_pairs >= PAIRS:
            self._compatible, self._n_pairs = [{} for _ in self.joins], 0
        self._n_pairs += 1
        out = self._compatible[a][b] = self._apart(self.joins[a][0], self.joins[b][1])
        return out

    def _apart(self, a: list, b: list) -> bool:
        """Whether no join across the border comes to be the next one, given the joins left and right of it in their order."""
        score = self.score.get
        i, j, low = 1, 1, float("-inf")
        (left, x), (right, y) = a[0], b[0]
        left, right = a[1][0] if len(a) > 1 else low, b[1][0] if len(b) > 1 else low
        while True:
            across = score(x + y)
            if across is not None and across > left and across >= right:  # of equals the leftmost
                return False
            if left == right == low:
                return True
            if left >= right:
                x, i = a[i][1], i + 1
                left = a[i][0] if i < len(a) else low
            else:
                y, j = b[j][1], j + 1
                right = b[j][0] if j < len(b) else low

    def learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct parts, as bytes of 32-bit numbers: last tokens forwards, ids backwards.

        Parts are taken in order of their characters; a part goes on with the table of the one before it as far as the two agree.
        """
        out = {}
        before_part = ""
        last, states = [-1], [0]  # the token that the prefix of each length ends with (-1: a character that the model does not know, or none)
        steps, ends, known, tokens = self._steps, self._ends, self._compatible, self.token
        for part in sorted(parts):
            at = 0
            for x, y in zip(part, before_part):
                if x != y:
                    break
                at += 1
            del last[at + 1 :], states[at + 1 :]
            state = states[at]
            for c in part[at:]:
                at += 1
                after = steps[state].get(c)
                state = after if after is not None else self._step(state, c)
                for size, token in ends[state]:
                    before = last[at - size]
                    if before < 0:
                        break
                    fits = known[before].get(token)
                    if fits is None:
                        fits = self.compatible(before, token)
                        known = self._compatible
                    if fits:
                        break
                else:
                    token = -1
                last.append(token)
                states.append(state)
            before_part = part
            ids = array("i")
            while at:
                token = last[at]
                text, i = tokens[token] if token >= 0 else (part[at - 1], None)
                if i is not None:
                    ids.append(i)
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in reversed(text.encode()))
                elif not ids or ids[-1] != self.unknown:  # the library gives neighbours without a piece one id
                    ids.append(self.unknown)
                at -= len(text)
            ids.reverse()
            out[part] = ids.tobytes()
        return out

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; parts are cut where no piece reaches across, and those not known are learned together."""
        normal = map(self.library.normalize, texts)
        parts = [self._part.findall(t) if self.sign else [t] for t in normal]
        if len(self._known) > PARTS:
            self._known.clear()
        new = set().union(*parts).difference(self._known)
        self._known.update(self.learn(p for p in new if len(p) <= PART_CHARS))
        rare = self.learn(p for p in new if len(p) > PART_CHARS)
        for own in parts:
            found = [*map(self._known.get, own)]
            if rare and None in found:
                found = [rare[p] if f is None else f for p, f in zip(own, found)]
            yield np.frombuffer(b"".join(found), np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The model of a file, once in a worker."""
    return Encoder(path)


def encoded(docs: DataFrame, model: str | None = None, text_col: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` and the ``ids`` (array of int) of each whole text, as the library's ``encode`` gives them without begin and end ids.

    With ``decoded``, also the text that the library's ``decode`` makes of the ids. Null counts as empty: no ids, an empty text.
    Each row stands for itself, so repeated rows come back repeated; an empty table gives no rows. The new columns get
    underscores where ``docs`` has columns of these names. A task holds one text, its ids and at least CHARS characters of others.
    """
    bound_batches(docs.sparkSession)
    model = model or model_path()
    ids, raw = unused(docs.columns, ids, "raw")
    schema = [*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        (decoded,) = unused([*docs.columns, ids], decoded)
        schema.append(T.StructField(decoded, T.StringType()))
    n, names = len(docs.columns), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)

        def rows(own: pa.RecordBatch, found: list[np.ndarray], back: list[str]) -> pa.RecordBatch:
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32())
            cols = [*own.columns[:n], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(back, pa.string())] if decoded else cols, names=names)

        for batch in batches:
            texts = batch.column(n)
            lo, held = 0, 0
            for k in range(len(batch)):
                held += len(texts[k].as_py())
                if held >= CHARS or k == len(batch) - 1:
                    found = [*e.ids(texts.slice(lo, k + 1 - lo).to_pylist())]
                    back = [e.library.decode(x.tolist()) for x in found] if decoded else []
                    yield rows(batch.slice(lo, k + 1 - lo), found, back)
                    lo, held = k + 1, 0

    return docs.withColumn(raw, F.coalesce(text_col, F.lit(""))).mapInArrow(run, T.StructType(schema))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """A model file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``n_tokens``, and hashes of the ids (decimal, joined by commas) and of the decoded text."""
    return rows.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
