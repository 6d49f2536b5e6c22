"""Spelling variants: words one edit apart, found with a frequency-vector trie.

A word becomes the vector of its counts in `GROUPS`, groups of letters.  One inserted, deleted or replaced letter changes
that vector by at most one surplus and one deficit.  Words are arranged in a trie by successive counts; a search goes down
depth first and spends a budget of one surplus and one deficit; the words of a leaf that it reaches are verified.

Spread over tasks, the first levels of the trie are the shards: a word is stored in the shard of its first counts and asks
in that shard and in those that a surplus of one (and a deficit of one in a later group) leads to; the other half of the
pairs is found from their other word.  The number of levels follows the vocabulary, until no shard holds more than `SHARD`
words, or all counts are used; words that still share a shard are split by hash, and a word asks in every part.  The words
that ask in a shard take turns of some `ASKS` words, each with the stored words, so a busy shard is many tasks.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import partitions, written

# Groups of letters in trie order; all other letters share the last group.
GROUPS = ("e", "a", "i", "n", "o", "r", "s", "t", "l", "d", "u", "h", "c", "m", "gq", "bvx", "pfy", "wjkz")
RUN = re.compile("[a-zÀ-ÿ]+")  # after lower-casing
PIECE = 1 << 20
FLUSH = 200_000
SHARD = 1 << 15
ASKS = 1 << 14
STATES = 1 << 18
PAIRS = 1 << 18
WIDE = 32


def _runs(text: str) -> Iterator[str]:
    """Maximal letter runs, A-Z in lower case; long texts a piece at a time, cut where a run ends."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and RUN.match(text[end - 1].lower() if text[end - 1].isascii() else text[end - 1]):
            end += 1
        yield from RUN.findall(text[at:end].encode().lower().decode())
        at = end


def _damaged(key: str, run: str, every: int) -> str:
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(every: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in Counter(_runs(text.as_py())).items():
                    word = _damaged(key, word, every) if every else word
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) >= FLUSH:
                    yield out()
                    total = Counter()
        yield out()
    return run


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 0, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the letter runs of all texts, those of at least `shortest` letters and `least` occurrences.  With
    `every`, a run whose checksum with the document's key is divisible by it loses one letter first."""
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return rows.mapInArrow(_count(every, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one array, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)


_GROUP = np.full(256, len(GROUPS))
for _i, _members in enumerate(GROUPS):
    _GROUP[[ord(letter) for letter in _members]] = _i


def vectors(words: list[str]) -> np.ndarray:
    """Counts of the letters of each group, a row for each word."""
    codes, lengths = _letters(words)
    group = np.where(codes < 256, _GROUP[np.minimum(codes, 255)], len(GROUPS))
    depth = len(GROUPS) + 1
    cells = np.bincount(np.repeat(np.arange(len(words)), lengths) * depth + group, minlength=len(words) * depth)
    return cells.reshape(len(words), depth)


def _prefix(counts: list[int]) -> str:
    return ",".join(map(str, counts))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors(batch.column(0).to_pylist()).tolist(), pa.list_(pa.int32()))], names=["word", "counts"])


def reached(prefix: list[int]) -> list[list[int]]:
    """The first counts of words that a word asks for: its own, those with one surplus, and those with one surplus and one
    deficit in a later group (with the deficit first, the other word asks)."""
    out = [prefix]
    for i in range(len(prefix)):
        more = prefix[:i] + [prefix[i] + 1] + prefix[i + 1:]
        out += [more, *(more[:j] + [more[j] - 1] + more[j + 1:] for j in range(i + 1, len(prefix)) if more[j])]
    return out


def _seats(levels: int):
    """Where a word stands (its own prefix) and asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shards, asks = [], [], []
            for word, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefixes = [_prefix(p) for p in reached(counts[:levels])]
                words += [word] * (len(prefixes) + 1)
                shards += [prefixes[0], *prefixes]
                asks += [False] + [True] * len(prefixes)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(shards, pa.string()), pa.array(asks, pa.bool_())], names=["word", "shard", "asks"])
    return run


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


class Letters:
    """Words as rows of code points; words longer than `WIDE` are compared as text."""

    def __init__(self, words: list[str]):
        codes, self.lengths = _letters(words)
        self.words, self.table = words, np.zeros((len(words), WIDE + 1), np.uint32)
        row = np.repeat(np.arange(len(words)), self.lengths)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.table[row[at < WIDE], at[at < WIDE]] = codes[at < WIDE]
        # Two letters at each end: an edit of a word of four letters or more leaves one of the ends as it was.
        ends, flat = np.cumsum(self.lengths), np.concatenate([codes, np.zeros(2, np.uint32)]).astype(np.int64)
        self.head, self.tail = (flat[at] << 32 | flat[at + 1] for at in (ends - self.lengths, np.maximum(ends - 2, 0)))


def verified(left: Letters, i: np.ndarray, right: Letters, j: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; the right word is as long as the left one or one letter longer."""
    a, b, size = left.table[i], right.table[j], left.lengths[i]
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), WIDE + 1)
    behind = a[:, :-1] != b[:, 1:]  # a letter of the left word against the next one of the right word
    behind &= np.arange(WIDE) < size[:, None]
    last = np.where(behind.any(1), WIDE - 1 - behind[:, ::-1].argmax(1), -1)
    longer = right.lengths[j] > size
    good = np.where(longer, last < first, differ.sum(1) == 1)
    for k in np.flatnonzero(right.lengths[j] > WIDE):
        good[k] = one_edit(left.words[i[k]], right.words[j[k]])
    return good


class Trie:
    """Words by successive counts.  A node of a level is a number; `children[level]` holds node * `width` + count of every
    child in order, and the child is the position of that value."""

    def __init__(self, words: list[str]):
        counts = vectors(words)
        order = np.lexsort(counts.T[::-1])
        self.words, counts = Letters([words[i] for i in order]), counts[order]
        self.width, self.children = int(counts.max()) + 3, []
        node = np.zeros(len(words), np.int64)
        for level in range(counts.shape[1]):
            keys, node = np.unique(node * self.width + counts[:, level], return_inverse=True)
            self.children.append(keys)
        self.begin = np.searchsorted(node, np.arange(node[-1] + 2))

    def search(self, asking: list[str]) -> Iterator[tuple[str, str]]:
        """(asking word, stored word) one edit apart, with the stored word as long or one letter longer.

        The stack holds blocks of states (asking word, node, surplus, deficit) of one level; the deepest block goes first,
        and a block of more than `STATES` is halved, so the stack stays small."""
        asked, letters = vectors(asking), Letters(asking)
        zero = np.zeros(len(asking), np.int64)
        stack = [(0, np.arange(len(asking)), zero, zero, zero)]
        while stack:
            level, who, node, more, less = stack.pop()
            if not len(who):
                continue
            if level == len(self.children):
                yield from self._leaves(letters, who, node, more - less)
                continue
            if len(who) > STATES:
                half = len(who) // 2
                stack += [(level, *(x[half:] for x in (who, node, more, less))), (level, *(x[:half] for x in (who, node, more, less)))]
                continue
            keys, parts = self.children[level], []
            for step in (-1, 0, 1):
                count = asked[who, level] + step
                able = (count >= 0) & (count < self.width) & (more + (step > 0) <= 1) & (less + (step < 0) <= 1)
                key = node[able] * self.width + count[able]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[at] == key
                chosen = np.flatnonzero(able)[there]
                parts.append((who[chosen], at[there], more[chosen] + (step > 0), less[chosen] + (step < 0)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))

    def _leaves(self, asking: Letters, who, node, balance) -> Iterator[tuple[str, str]]:
        who, node = who[balance >= 0], node[balance >= 0]  # with a deficit alone the stored word is shorter
        size = self.begin[node + 1] - self.begin[node]
        for first, last in _parts(size):
            n = size[first:last]
            i = np.repeat(who[first:last], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[node[first:last]], n)
            alike = (asking.head[i] == self.words.head[j]) | (asking.tail[i] == self.words.tail[j]) | (asking.lengths[i] < 4)
            i, j = i[alike], j[alike]
            good = verified(asking, i, self.words, j)
            yield from ((asking.words[a], self.words.words[b]) for a, b in zip(i[good].tolist(), j[good].tolist()))


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of leaves with some `PAIRS` pairs in all; one leaf has at most `SHARD` words."""
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PAIRS)))
        yield first, last
        first = last


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, asks, word) by shard and part, the stored words first; gives both directions of every pair."""
    held, trie, stored, asking = None, None, [], []

    def pairs(closing: bool) -> Iterator[pa.RecordBatch]:
        nonlocal trie, asking
        if stored and asking:
            trie = trie or Trie(stored)
            found = set()
            for a, b in trie.search(asking):
                found |= {(a, b), (b, a)}
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*found) if found else ([], []))], names=["word", "near"])
        asking = []
        if closing:
            trie = None
            stored.clear()
    for batch in batches:
        for shard, part, asks, word in zip(*(c.to_pylist() for c in batch.columns)):
            if (shard, part) != held:
                yield from pairs(True)
                held = (shard, part)
            if asks:
                asking.append(word)
                if len(asking) >= SHARD:
                    yield from pairs(False)
            else:
                stored.append(word)
    yield from pairs(True)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) of all ordered pairs of different words one edit apart; `words` holds each word once."""
    counted = written(words.select("word").mapInArrow(_vectors, "word string, counts array<int>"), "word-vectors")
    depth = len(GROUPS) + 1
    sizes = counted.select(F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("levels"), "counts")
    sizes = sizes.groupBy("levels", F.slice("counts", 1, F.col("levels")).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).groupBy("levels").agg(F.max("n").alias("n"))
    fitting = [r["levels"] for r in sizes.orderBy("levels").collect() if r["n"] <= SHARD]  # one row for each level
    seats = written(counted.mapInArrow(_seats(min(fitting, default=depth)), "word string, shard string, asks boolean"), "word-seats")
    # A shard of many words is split by hash; every asking word visits each part, and many asking words share the work.
    sizes = seats.groupBy("shard").agg(F.ceil(F.count_if(~F.col("asks")) / SHARD).cast("int").alias("parts"), F.ceil(F.count_if("asks") / ASKS).cast("int").alias("turns"))
    hashed = F.xxhash64("word")
    parts = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(hashed, F.col("parts")).cast("int")))
    turns = F.when(F.col("asks"), F.array(F.pmod(hashed, F.col("turns")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("turns") - 1))
    placed = (seats.join(sizes.where("parts > 0"), "shard").select("shard", "asks", "word", F.explode(parts).alias("p"), turns.alias("turns"))
              .select("shard", "asks", "word", "p", F.explode("turns").alias("turn")).select("shard", F.concat_ws(".", "p", "turn").alias("part"), "asks", "word"))
    dealt = placed.repartition(partitions(words.sparkSession), "shard", "part").sortWithinPartitions("shard", "part", "asks")
    return dealt.mapInArrow(_find, "word string, near string").distinct()


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 0, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of all texts.

    Near words are one inserted, deleted or replaced letter apart.  A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least `times` its own, which must exceed 1; root follows forms to the last.

    Null and empty texts hold no words; rows are read one by one, so repeated rows count repeatedly; a null key reads as
    an empty one.  An empty table gives no rows; other columns are not read."""
    words = written(vocabulary(df, key, text, every, shortest, least), "vocabulary")
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("larger", -F.col("best.less") >= F.col("n") * times)
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("larger"), F.col("best.near")).alias("form"), F.when(F.col("larger"), -F.col("best.less")).alias("form_n"))
    known = written(known, "forms")
    # Pointers double: after round i a pointer has passed 2^i forms.  n grows with every form, so they end.
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = written(roots, "roots")
        later = roots.select(F.col("word").alias("root"), F.col("root").alias("later"))
        moved = roots.join(later, "root", "left")
        if moved.where("later is not null").isEmpty():
            break
        roots = moved.select("word", F.coalesce("later", "root").alias("root"))
    return (known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
