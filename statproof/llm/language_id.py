"""Language identification by prediction by partial matching.

Per language a byte context tree of orders 0 to `ORDER` is counted on a bounded sample of labelled texts and then
frozen.  The code length of a byte is -log2 of its probability in the longest context that has been followed by it;
every longer context first pays its escape probability (method C: distinct followers / (count + distinct followers)),
and a byte never seen pays the uniform code.  Frozen statistics make the code length a function of the last
`ORDER` + 1 bytes, so it is tabulated per context and byte for `GROUP` languages at once, in 1/65,536 bits, and summed as
integers: exact, and independent of batches and groups.  Texts are scored whole; each starts after `ORDER` zero bytes.
"""
from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import slices, written

ORDER = 3
SAMPLE_DOCS = 256        # labelled texts per language
SAMPLE_BYTES = 1 << 16   # longer texts are learned from only where a language has no others; all are scored whole
GROUP = 4                # languages in one table; a worker holds one table at a time when there are several
CELLS = 1 << 22          # code lengths (texts x languages) held at a time
PIECE = 1 << 18          # bytes scored at a time
SLICE = 1 << 22          # bytes of text taken from an Arrow batch at a time
SAMPLE_TASKS = 8         # the sample is small: few tasks count it, so few tasks send the same grams
BIT = 65_536


class Scorer:
    """Code lengths of every language from counts of (language, order, gram, count)."""

    def __init__(self, languages: list[str], rows: list[tuple[int, int, int, int]]):
        self.languages, k = languages, len(languages)
        if not languages:
            return
        counts: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in range(ORDER + 1)]
        for lang, order, gram, n in sorted(rows):
            counts[order].setdefault(gram >> 8, []).append((lang, gram & 255, n))
        seen = sorted({byte for followers in counts[0].values() for _, byte, _ in followers})
        self.symbol = np.full(256, len(seen), np.int64)  # bytes that were never seen share one symbol
        self.symbol[seen] = np.arange(len(seen))
        levels: list[dict[int, np.ndarray]] = []
        for order in range(ORDER + 1):
            level: dict[int, np.ndarray] = {}
            for context, followers in counts[order].items():
                cost = self._shorter(levels, order, context, len(seen) + 1, k).copy()
                total, kinds = np.zeros(k), np.zeros(k)
                for lang, _, n in followers:
                    total[lang] += n
                    kinds[lang] += 1
                cost += np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
                for lang, byte, n in followers:
                    cost[self.symbol[byte], lang] = np.log2((total[lang] + kinds[lang]) / n)
                level[context] = cost
            levels.append(level)
        # One table for every context of full length that was seen; `state` finds what the others fall back to.
        full = sorted(levels[ORDER])
        tables, shorter, state = [levels[ORDER][c] for c in full], {}, np.zeros(1 << 8 * (ORDER - 1), np.int64)
        for context in range(len(state)):
            order, key = ORDER - 1, context
            while order and key not in levels[order]:
                order, key = order - 1, key & ((1 << 8 * (order - 1)) - 1)
            if (order, key) not in shorter:
                shorter[order, key] = len(tables)
                tables.append(levels[order].get(key, np.full((len(seen) + 1, k), 8.0)))
            state[context] = shorter[order, key]
        self.full, self.state = np.array(full, np.int32), state
        self.costs = np.rint(np.stack(tables) * BIT).astype(np.int32).reshape(-1, k).T.copy()

    @staticmethod
    def _shorter(levels: list, order: int, context: int, symbols: int, k: int) -> np.ndarray:
        for shorter in range(order - 1, -1, -1):
            found = levels[shorter].get(context & ((1 << 8 * shorter) - 1))
            if found is not None:
                return found
        return np.full((symbols, k), 8.0)

    def score(self, bodies: list[bytes]) -> np.ndarray:
        """Code length of each text in each language, in 1/65,536 bits.  Texts are taken in pieces of `PIECE` bytes, each
        after the bytes that its first context needs, so memory does not grow with a text; integer sums stay exact."""
        out = np.zeros((len(bodies), len(self.languages)), np.int64)
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, body in enumerate(bodies):
            for at in range(0, len(body), PIECE):
                piece = body[at:at + PIECE]
                before = body[max(0, at - ORDER):at]
                held.append((i, bytes(ORDER - len(before)) + before + piece))
                size += len(piece)
                if size >= PIECE:
                    self._add(out, held)
                    held, size = [], 0
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, pieces: list[tuple[int, bytes]]) -> None:
        raw = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        context = np.zeros(len(raw), np.int32)
        for i in range(1, ORDER + 1):
            context[ORDER:] |= raw[ORDER - i:len(raw) - i].astype(np.int32) << 8 * (i - 1)
        at = np.searchsorted(self.full, context)
        at[at == len(self.full)] = 0
        row = np.where(self.full[at] == context, at, self.state[context & (len(self.state) - 1)])
        row = row * (int(self.symbol.max()) + 1) + self.symbol[raw]
        starts = np.cumsum([0, *(len(p) for _, p in pieces)])[:-1]
        lead = (starts[:, None] + np.arange(ORDER)).ravel()  # the bytes before a piece are not its own
        texts = [i for i, _ in pieces]
        for lang, costs in enumerate(self.costs):
            cost = costs[row]
            cost[lead] = 0
            np.add.at(out[:, lang], texts, np.add.reduceat(cost, starts, dtype=np.int64))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, n) of each batch of (lang, text)."""
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body = bytes(ORDER) + text.encode()
            # Pieces of a long text overlap by the context of their first byte.
            texts.setdefault(lang, []).extend(body[i:i + SAMPLE_BYTES + ORDER] for i in range(0, len(body) - ORDER, SAMPLE_BYTES))
        for lang, bodies in texts.items():
            for first in range(0, len(bodies), SAMPLE_DOCS):
                for order in range(ORDER + 1):
                    grams = []
                    for body in bodies[first:first + SAMPLE_DOCS]:
                        raw = np.frombuffer(body, np.uint8).astype(np.int64)
                        gram = np.zeros(len(raw) - ORDER, np.int64)
                        for i in range(order + 1):
                            gram |= raw[ORDER - i:len(raw) - i] << 8 * i
                        grams.append(gram)
                    values, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(np.full(len(values), order, np.int32)), pa.array(values), pa.array(n.astype(np.int64))], names=["lang", "order", "gram", "n"])


def packed(scorer: Scorer) -> bytes:
    """Compressed: a table of code lengths repeats itself, and it passes through the driver."""
    return zstandard.ZstdCompressor(level=9).compress(pickle.dumps(scorer, pickle.HIGHEST_PROTOCOL))


def unpacked(data: bytes) -> Scorer:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _tables(numbers: dict[str, int]):
    """The packed scorer of each group of languages, from its rows of (group, lang, order, gram, n)."""
    names = sorted(numbers, key=numbers.get)

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        columns = [table.column(c).to_pylist() for c in ("lang", "order", "gram", "n")]
        scorer = Scorer(names[group * GROUP:(group + 1) * GROUP], [(numbers[lang] % GROUP, order, gram, n) for lang, order, gram, n in zip(*columns)])
        return pa.table({"group": pa.array([group], pa.int32()), "scorer": pa.array([packed(scorer)], pa.binary())})
    return run


def _chosen(rows: list) -> list[tuple]:
    """(lang, class, size, key) of the texts to learn from, of rows (lang, class, best): those of at most `SAMPLE_BYTES`, or
    for a language without such texts its shortest ones, as many as make `SAMPLE_DOCS` * `SAMPLE_BYTES` and at least one."""
    found = defaultdict(list)
    for lang, klass, best in rows:
        found[lang].append((best["size"], best["h"], klass, best["k"]))
    out = []
    for lang, texts in found.items():
        short = [t for t in texts if t[0] <= SAMPLE_BYTES]
        total = 0
        for size, _, klass, k in short or sorted(texts, key=lambda t: t[:2]):
            total += size
            if short or total == size or total <= SAMPLE_DOCS * SAMPLE_BYTES:
                out.append((lang, klass, size, k))
    return out


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list]:
    """Names of the labelled languages, and a broadcast table for each `GROUP` of them.

    Of each language, at most one text in each of `SAMPLE_DOCS` hash classes of the key is read, whole, and none longer
    than `SAMPLE_BYTES`; a language that has only longer texts is learned from its shortest ones.  So the driver gets
    at most `SAMPLE_DOCS` keys of each language, and one table at a time; tables are built in Spark.  Any number of
    labels is learned.  Rows without key, text or label teach nothing."""
    spark = df.sparkSession
    rows = (df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")).dropna()
            .withColumn("_size", F.octet_length("_text")).where(F.col("_size") > 0))
    hashed = F.xxhash64("_key")
    rows = rows.withColumn("_class", F.pmod(hashed, F.lit(SAMPLE_DOCS)).cast("int"))
    long = F.when(F.col("_size") > SAMPLE_BYTES, F.col("_size")).otherwise(0)
    best = F.min(F.struct(long.alias("long"), hashed.alias("h"), F.col("_key").alias("k"), F.col("_size").alias("size")))
    chosen = _chosen(rows.groupBy("_lang", "_class").agg(best.alias("best")).collect())
    names = sorted({r[0] for r in chosen})
    if not names:
        return [], []
    picked = F.broadcast(spark.createDataFrame(chosen, rows.select("_lang", "_class", "_size", "_key").schema))
    sample = rows.join(picked, ["_lang", "_class", "_size", "_key"]).groupBy("_lang", "_class").agg(F.min("_text").alias("_text"))
    numbers = {name: i for i, name in enumerate(names)}
    groups = F.broadcast(spark.createDataFrame([(name, i // GROUP) for name, i in numbers.items()], "lang string, group int"))
    counts = (sample.select("_lang", "_text").coalesce(SAMPLE_TASKS).mapInArrow(_grams, "lang string, order int, gram long, n long")
              .groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")).join(groups, "lang"))
    tables = written(counts.groupBy("group").applyInArrow(_tables(numbers), "group int, scorer binary"), "languages")
    return names, [spark.sparkContext.broadcast(tables.where(F.col("group") == g).first()["scorer"]) for g in range(-(-len(names) // GROUP))]


def _slices(batch: pa.RecordBatch, at_text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some `SLICE` bytes of text, so that little more than one slice is held besides it."""
    return slices(batch, at_text, SLICE)


def predict(df: DataFrame, model: tuple[list[str], list], keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with lang_pred, score (probability of the winner among the learned languages at equal priors) and
    bits_per_byte (its code length per byte; null for `und`).

    `und` with score 0: null text, text without a letter, or nothing learned.  Equal code lengths go to the first name.
    Every row gives a row, whatever its other columns hold."""
    languages, tables = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Scorer] = []

        def scorers() -> Iterator[Scorer]:
            if len(tables) == 1:
                if not held:
                    held.append(unpacked(tables[0].value))
                yield held[0]
            else:
                for table in tables:
                    yield unpacked(table.value)
                    if getattr(table, "_path", None):  # it can be read again from its file
                        vars(table).pop("_value", None)

        for whole in batches:
            for batch in _slices(whole, at_text):
                texts, letters = batch.column(at_text), batch.column(batch.num_columns - 1).to_pylist()
                names, scores, bits = ["und"] * len(letters), [0.0] * len(letters), [None] * len(letters)
                wanted = [i for i, letter in enumerate(letters) if letter and languages]
                part = max(1, CELLS // max(1, len(languages)))
                for first in range(0, len(wanted), part):
                    rows = wanted[first:first + part]
                    bodies = [texts[i].as_buffer().to_pybytes() for i in rows]
                    costs = np.concatenate([scorer.score(bodies) for scorer in scorers()], axis=1)
                    for i, body, row in zip(rows, bodies, costs):
                        best = int(row.argmin())
                        names[i], bits[i] = languages[best], float(row[best]) / BIT / len(body)
                        scores[i] = float(1 / np.exp2(-np.minimum((row - row[best]) / BIT, 1000.0)).sum())
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=out)
    named = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    body = F.col(text).cast("string")
    once = text in keep and isinstance(df.schema[text].dataType, T.StringType)  # a text that is kept travels once
    at_text = keep.index(text) if once else len(keep)
    rows = df.select(*named, *([] if once else [body.alias("_text")]), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    out = [*(f"_{i}" for i in range(len(keep))), "lang_pred", "score", "bits_per_byte"]
    schema = T.StructType([*rows.drop("_text", "_letter").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits_per_byte")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the labelled rows that are not held out, then predict every row."""
    return predict(df, train(df.where(~held_out(key)), key, text, lang), keep, text)
