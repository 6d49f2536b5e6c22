"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking.

A token sequence is the merge result of a text exactly if every two neighbouring tokens are compatible: re-merging
their joined text must give the same two tokens.  The encoder walks from left to right, tries the longest token (found
by an Aho-Corasick automaton), then shorter ones, checks compatibility with the
previous token, and keeps the positions from which no continuation exists in a bitfield, so every position fails once.

Spaces become U+2581.  A text is cut at seams, between characters that stand side by side in no token, and each segment
is encoded on its own; segments are memoised per process.  Pieces that share one score (runs of marks) merge after all
others, leftmost first; they are applied to the marks in front of a word.
"""
from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import Memo

MARK = "▁"
MEMO = 500_000
RUN = re.compile(f"({MARK}{{2,}}[^{MARK}]*|{MARK}$)")


class Model:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("a merge-type model with identity normalisation and a dummy prefix is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.eos = SentencePieceProcessor(model_file=path).eos_id()
        self.surface: list[str | int | None] = []  # text of a piece, byte value, or nothing (control)
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece], scores[p.piece] = i, p.score
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            self.surface.append(p.piece.replace(MARK, " ") if p.type == kinds.NORMAL else int(p.piece[1:-1], 16) if p.type == kinds.BYTE else " ⁇ " if p.type == kinds.UNKNOWN else None)
        self.special = {i for i, piece in enumerate(self.surface) if not isinstance(piece, str)}
        if len(self.bytes) != 256:
            raise ValueError("byte fallback is needed")
        seen: dict[float, int] = {}
        for token, score in scores.items():
            seen[score] = seen.get(score, 0) + (len(token) > 1)
        tied = {t for t, s in scores.items() if len(t) > 1 and seen[s] > 1}
        lowest = min((s for t, s in scores.items() if len(t) > 1 and t not in tied), default=0)
        if any(MARK in t.lstrip(MARK) for t in scores) or any(t.strip(MARK) or scores[t] >= lowest for t in tied):
            raise ValueError("marks inside pieces, or tied scores of other pieces, are not supported")
        self.runs = {t: scores[t] for t in tied}
        order = sorted((t for t in scores if len(t) > 1 and t not in tied), key=lambda t: -scores[t])
        self.rank = {t: i for i, t in enumerate(order)}
        self.chars = {t for t in scores if len(t) == 1}
        self.split: dict[str, tuple[str, str]] = {}
        for token in order:
            if self.merged(token) == [token]:
                self.split[token] = self.last
        self.automaton = ahocorasick.Automaton()
        self.length, self.shorter, self.text = [0] * len(self.surface), [-1] * len(self.surface), [""] * len(self.surface)
        for token in [*self.split, *self.chars]:
            i = self.ids[token]
            self.automaton.add_word(token, i)
            self.length[i], self.text[i] = len(token), token
            self.shorter[i] = next((self.ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.split or k == 1), -1)
        self.automaton.make_automaton()
        self.pairs = Memo(lambda pair: self.compatible(self.text[pair >> 24], self.text[pair & 0xFFFFFF]))
        self.kind = np.zeros(0x110000, np.uint16)
        for i, c in enumerate(sorted(self.chars), 1):
            self.kind[ord(c)] = i
        self.joined = np.zeros((len(self.chars) + 1,) * 2, bool)
        for t in self.split:
            kinds = self.kind[[ord(c) for c in t]]
            self.joined[kinds[:-1], kinds[1:]] = True
        self.segment = Memo(lambda segment: self._shown(self.segment_ids(segment)), MEMO)
        self.run = Memo(lambda unit: self._shown(self.run_ids(unit)), MEMO // 8)

    def merged(self, text: str) -> list[str]:
        """Plain merging, for the tokens of the model only."""
        parts, self.last = list(text), None
        while True:
            best = min(((self.rank.get(a + b, len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(len(self.rank), 0))
            if best[0] == len(self.rank):
                return parts
            i = best[1]
            self.last = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Undo the merges of both tokens, latest first; at no time may the two pieces at the border merge before the
        merge that takes one of them away.  Equal ranks go from left to right."""
        never = len(self.rank)
        before_left, up_to_right = never, never
        while True:
            joined = self.rank.get(left + right, never)
            if joined < before_left and joined <= up_to_right and joined < never:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before_left, left = a, self.split[left][1]
            else:
                up_to_right, right = b, self.split[right][0]

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the model."""
        size, search = len(text), self.automaton.iter_long
        length, shorter, pairs = self.length, self.shorter, self.pairs
        tokens: list[int] = []
        at, last, failed = 0, -1, 0
        ahead = search(text)  # longest matches one after another, as long as all are compatible
        token = next(ahead)[1]
        while True:
            end = at + length[token]
            if not failed >> end & 1 and (last < 0 or pairs[last << 24 | token]):
                tokens.append(token)
                if end == size:
                    return tokens
                at, last = end, token
                token = next(ahead or search(text, at))[1]
                continue
            ahead = None
            token = shorter[token]
            while token < 0:
                failed |= 1 << at
                token = tokens.pop()
                at -= length[token]
                token = shorter[token]
                last = tokens[-1] if tokens else -1

    def run_of_marks(self, count: int) -> list[str]:
        """Marks that no other merge has taken: tied merges, best score first, then leftmost."""
        size, nxt, prev = [1] * count, list(range(1, count + 1)), list(range(-1, count - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and nxt[i] < count and (s := self.runs.get(MARK * (size[i] + size[nxt[i]]))) is not None:
                heapq.heappush(heap, (-s, i, size[i], size[nxt[i]]))
        for i in range(count):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if size[i] != a or nxt[i] >= count or size[nxt[i]] != b:
                continue
            j = nxt[i]
            size[i], size[j], nxt[i] = a + b, 0, nxt[j]
            if nxt[j] < count:
                prev[nxt[j]] = i
            offer(prev[i])
            offer(i)
        return [MARK * s for s in size if s]

    def segments(self, text: str) -> list[str]:
        """Cut a text between characters that stand side by side in no token: no merge crosses such a seam."""
        kinds = self.kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        seams = (np.flatnonzero(~self.joined[kinds[:-1], kinds[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *seams], [*seams, len(text)])]

    def segment_ids(self, segment: str) -> list[int]:
        """A character outside the model is a segment of its own and becomes its bytes."""
        if segment not in self.chars and len(segment) == 1:
            return [self.bytes[b] for b in segment.encode()]
        return self.backtrack(segment)

    def run_ids(self, unit: str) -> list[int]:
        """Ids of a run of marks and what follows: the last mark may merge with that, the others form a run."""
        body = unit.lstrip(MARK)
        marks = len(unit) - len(body)
        ids = [i for segment in self.segments(MARK + body) for i in self.segment_ids(segment)] if body else []
        if ids and ids[0] == self.ids[MARK]:
            ids = ids[1:]
        elif ids:
            marks -= 1
        return [self.ids[t] for t in self.run_of_marks(marks)] + ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the mark of the dummy prefix still in front as a space."""
        pieces = [self.surface[i] for i in ids]
        if not self.special.isdisjoint(ids):
            out, raw = [], bytearray()
            for piece in pieces:
                if isinstance(piece, int):
                    raw.append(piece)
                elif piece is not None:
                    out += [raw.decode("utf-8", "replace"), piece]
                    raw.clear()
            pieces = [*out, raw.decode("utf-8", "replace")]
        return "".join(pieces)

    def _shown(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def encode_text(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        if not text:
            return "", ""
        found: list[tuple[str, str]] = []
        for k, part in enumerate(RUN.split(MARK + text.replace(" ", MARK))):
            if k % 2:
                found.append(self.run[part])
            elif part:
                found += map(self.segment.__getitem__, self.segments(part))
        return " ".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text)[0].split()]


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode_table(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256 (end id counted), and with `full` also ids and decoded.

    Null and empty texts give the end id alone and an empty decoded text.  Repeated rows, null keys and ties give a row
    each; other columns are not read; an empty table gives no rows.  The model file must be on every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids, decoded = m.encode_text(t or "")
                ids = f"{ids} {m.eos}" if ids else str(m.eos)
                rows.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((list(map(int, ids.split())), decoded) if full else ())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            columns = list(zip(*rows)) or [[]] * (5 if full else 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
