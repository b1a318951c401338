"""Language ID by interpolated Kneser-Ney character models.

Letters are lower-cased, and every run of other characters is one blank. The n-grams of all labelled documents are
counted where the texts are read and added up by a shuffle; a language's different n-grams are then smoothed with one discount
for each order, and stored in sorted arrays of n-gram hashes. Arrays of all languages are then joined, with every
language's probability beside each n-gram, so that one lookup serves them all. A document gets
the language of lowest cross-entropy per character over its whole text. One labelled document in HELD_BACK, scored by models
that have not seen it, calibrates the score and the entropy above which a document is rejected as no learned language.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, chunks, cut, small_batches, stored, table, utf8
from .words import mix

ORDER = 4
#: Bytes of a language, and of one text, in a sample that is asked for.
SAMPLE_BYTES, EACH = 8 << 20, 1 << 20
#: Rows of a table of languages, or of chosen documents, that is broadcast.
BROADCAST_ROWS = 1 << 17
#: Letters times languages that are scored at once, however long a text is.
SLICE = 1 << 20
#: One in so many labelled documents calibrates.
HELD_BACK = 5
#: Scales of the score that are tried, and cells of a nat in which entropies are counted.
SCALES, CELLS = (1, 2, 5, 10, 20, 50, 100, 200), 1000
#: Counts that a task holds before it adds up equal n-grams, and different n-grams that it holds before it hands them on.
PENDING, HELD = 1 << 20, 1 << 19
#: How far above the calibration texts a text's cross-entropy may lie before it is rejected.
MARGIN = 1.5
UNKNOWN = "und"
_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Lower-case code point of each letter, 0 of any other character."""
    if not _FOLDED:
        made = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                made[i] = ord(low) if len(low) == 1 else i
        _FOLDED.append(made)
    return _FOLDED[0]


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the joined texts with ORDER - 1 blanks before each and one after, text numbers, and which are scored."""
    blank = " " * (ORDER - 1)
    joined = "".join(f"{blank}{t.decode()} " for t in texts)
    code = _folded()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    n = np.fromiter((len(t.decode()) + ORDER for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), n)
    first = np.zeros(len(code), bool)
    ends = np.cumsum(n)
    lead = (ends - n)[:, None] + np.arange(ORDER - 1)
    first[lead.ravel()] = True
    keep = first | (code != 0) | np.concatenate([[True], code[:-1] != 0])
    # a blank right after the lead is part of it
    after = np.zeros(len(code), bool)
    after[lead[:, -1] + 1] = True
    keep &= ~(after & (code == 0))
    return code[keep], text[keep], ~first[keep]


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place; the first n - 1 places have none that is meant."""
    out = np.zeros(len(code), np.uint64)
    for k in range(n):
        shifted = np.zeros(len(code), np.uint64)
        shifted[n - 1 - k :] = code[: len(code) - (n - 1 - k)]
        out = out * np.uint64(0x100000001B3) + shifted + np.uint64(1)
    return mix(out, n)


def hashed(code: np.ndarray) -> np.ndarray:
    """Hash of each column of letters, as ``gram_hashes`` has it."""
    out = np.zeros(code.shape[1], np.uint64)
    for row in code:
        out = out * np.uint64(0x100000001B3) + row.astype(np.uint64) + np.uint64(1)
    return mix(out, len(code))


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns of ORDER letters and their counts in all texts; columns may come again. Texts without letters have none."""
    code, text, scored = letters([t for t in texts if any(c.isalpha() for c in t.decode())])
    for begin in range(0, len(code), SLICE):
        place = np.flatnonzero(scored[begin : begin + SLICE]) + begin
        columns = np.stack([code[place - k] for k in range(ORDER - 1, -1, -1)])
        wide = (columns > 0xFFFF).any(axis=0)
        key = np.zeros(int((~wide).sum()), np.uint64)
        for row in columns[:, ~wide]:
            key = key << np.uint64(16) | row.astype(np.uint64)
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        one = key[new]
        yield np.stack([(one >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.uint32) for k in range(ORDER - 1, -1, -1)]), np.diff(new, append=len(key))
        if wide.any():
            yield np.unique(columns[:, wide], axis=1, return_counts=True)


@dataclass
class SortedHashes:
    """Ascending hashes, and where each value of their top bits begins."""

    keys: np.ndarray

    def __post_init__(self):
        self.bits = max(1, min(22, int(len(self.keys)).bit_length()))
        self.start = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.deepest = int(np.diff(self.start, append=len(self.keys)).max()) if len(self.keys) else 0
        self.padded = np.append(self.keys, np.uint64(2**64 - 1))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, or -1."""
        at = self.start[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = np.flatnonzero(self.padded[at] < wanted)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.padded[at[open_]] < wanted[open_]]
        at[(self.padded[at] != wanted) | (at >= len(self.keys))] = -1
        return at


class KneserNey:
    """One language: log probabilities of seen n-grams and log weights of their contexts, by order."""

    def __init__(self, texts: list[bytes]):
        parts = list(ngrams(texts))
        self.fit(np.concatenate([c for c, _ in parts], axis=1), np.concatenate([n for _, n in parts]))

    @classmethod
    def of(cls, code: np.ndarray, counts: np.ndarray) -> KneserNey:
        """The language with these n-grams, columns of ORDER letters, and their counts."""
        made = cls.__new__(cls)
        made.fit(code, counts)
        return made

    def fit(self, code: np.ndarray, times: np.ndarray) -> None:
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        grams = {n: hashed(code[ORDER - n :]) for n in range(1, ORDER + 1)}
        context = {n: hashed(code[ORDER - n : -1]) if n > 1 else np.zeros(code.shape[1], np.uint64) for n in grams}
        place = np.arange(code.shape[1])
        self.letters = np.unique(grams[1])
        lower_p = None
        counts = {ORDER: times}
        rows = {ORDER: place}
        for n in range(ORDER - 1, 0, -1):  # a lower order counts the different n-grams one longer that end in it
            _, one = np.unique(grams[n + 1][rows[n + 1]], return_index=True)
            rows[n] = rows[n + 1][one]
            counts[n] = np.ones(len(rows[n]), np.int64)
        self.weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, ORDER + 1):
            key, first, inverse = np.unique(grams[n][rows[n]], return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=counts[n]).astype(np.float64)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx = context[n][rows[n]][first]
            ctx_key, ctx_of = np.unique(ctx, return_inverse=True)
            total = np.bincount(ctx_of, weights=count)
            kinds = np.bincount(ctx_of).astype(np.float64)
            weight = discount * kinds / total
            shorter = np.full(len(key), 1.0 / (len(self.letters) + 1)) if n == 1 else np.exp(lower_p[1][np.searchsorted(lower_p[0], grams[n - 1][rows[n]][first])])
            p = np.log((count - discount) / total[ctx_of] + weight[ctx_of] * shorter)
            self.grams[n] = (key, p, ctx)
            self.weights[n] = (ctx_key, np.log(weight))
            lower_p = (key, p)
        # the shorter n-gram of each n-gram seen, to back off from one language's n-gram in another
        self.shorter = {n: grams[n - 1][rows[n]][np.unique(grams[n][rows[n]], return_index=True)[1]] for n in range(2, ORDER + 1)}

    def dump(self) -> bytes:
        file = io.BytesIO()
        arrays = {"letters": self.letters}
        for n in range(1, ORDER + 1):
            arrays |= {f"k{n}": self.grams[n][0], f"p{n}": self.grams[n][1], f"c{n}": self.grams[n][2], f"wk{n}": self.weights[n][0], f"w{n}": self.weights[n][1]}
            if n > 1:
                arrays[f"s{n}"] = self.shorter[n]
        np.savez(file, **arrays)
        return file.getvalue()


class Models:
    """All languages: at each n-gram that any has seen, the log probability in every language."""

    def __init__(self, names: list[str], dumps: list[bytes]):
        self.names = names
        raw = [dict(np.load(io.BytesIO(d))) for d in dumps]
        self.scale, self.limit, self.slack = 30.0, float("inf"), 0.0
        self.unseen = np.array([-np.log(len(r["letters"]) + 1) + (r["w1"][0] if len(r["w1"]) else 0) for r in raw], np.float32)
        self.grams, self.p, self.contexts, self.w = {}, {}, {}, {}
        for n in range(1, ORDER + 1):
            key = np.unique(np.concatenate([r[f"k{n}"] for r in raw]))
            ctx, short = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)
            for r in raw:
                at = np.searchsorted(key, r[f"k{n}"])
                ctx[at] = r[f"c{n}"]
                if n > 1:
                    short[at] = r[f"s{n}"]
            contexts = np.unique(np.concatenate([r[f"wk{n}"] for r in raw]))
            w = np.zeros((len(contexts), len(raw)), np.float32)
            for i, r in enumerate(raw):
                w[np.searchsorted(contexts, r[f"wk{n}"]), i] = r[f"w{n}"]
            if n == 1:
                p = np.repeat(self.unseen[None, :], len(key), axis=0)
            else:
                p = w[np.searchsorted(contexts, ctx)] + self.p[n - 1][np.searchsorted(self.grams[n - 1].keys, short)]
            for i, r in enumerate(raw):
                p[np.searchsorted(key, r[f"k{n}"]), i] = r[f"p{n}"]
            self.grams[n], self.p[n], self.contexts[n], self.w[n] = SortedHashes(key), p.astype(np.float32), SortedHashes(contexts), w

    def log_p(self, grams: dict[int, np.ndarray], context: dict[int, np.ndarray], n: int = ORDER) -> np.ndarray:
        """Log probability of each place in every language, from order n down."""
        at = self.grams[n].find(grams[n])
        out = self.p[n][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if n == 1:
                out[miss] = self.unseen
            else:
                seen = self.contexts[n].find(context[n][miss])
                back = np.where(seen[:, None] >= 0, self.w[n][seen], np.float32(0))
                out[miss] = back + self.log_p({k: v[miss] for k, v in grams.items() if k < n}, {k: v[miss] for k, v in context.items() if k < n}, n - 1)
        return out

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in every language (nats), and its letters."""
        code, text, scored = letters(texts)
        n_letters = np.bincount(text, weights=code > 0, minlength=len(texts))
        sums, count = np.zeros((len(texts), len(self.names))), np.bincount(text[scored], minlength=len(texts))
        step = max(1, SLICE // max(1, len(self.names)))
        for begin in range(0, len(code), step):
            # as many letters before as the longest n-gram and its context need
            lead = min(begin, ORDER)
            part = code[begin - lead : begin + step]
            grams = {n: gram_hashes(part, n) for n in range(1, ORDER + 1)}
            context = {n: np.concatenate([[np.uint64(0)], grams[n - 1][:-1]]) for n in range(2, ORDER + 1)}
            place = np.flatnonzero(scored[begin : begin + step]) + lead
            if not len(place):
                continue
            log_p = self.log_p({n: g[place] for n, g in grams.items()}, {n: c[place] for n, c in context.items()})
            owner = text[place + begin - lead]
            new = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[new]] += np.add.reduceat(log_p, new, axis=0, dtype=np.float64)
        return -sums / np.maximum(count, 1)[:, None], n_letters

    def judged(self, texts: list[bytes], truth: list[str]) -> dict[tuple[str, int], float]:
        """Sums over the texts: log likelihood of the true languages under each scale, and how many have their lowest entropy in each cell."""
        out: dict[tuple[str, int], float] = {}
        known = {name: i for i, name in enumerate(self.names)}
        rows = [(x, known[lang]) for x, lang in zip(texts, truth, strict=True) if lang in known and any(c.isalpha() for c in x.decode())]
        for a, b in chunks([x for x, _ in rows], 1 << 19):
            h, _ = self.entropies([x for x, _ in rows[a:b]])
            right = np.array([i for _, i in rows[a:b]])
            best = h.min(axis=1)
            for scale in SCALES:
                z = -scale * (h - best[:, None])
                told = z[np.arange(len(h)), right] - np.log(np.exp(z).sum(axis=1))
                out["scale", scale] = out.get(("scale", scale), 0.0) + float(told.sum())
            for cell, n in zip(*np.unique((best * CELLS).astype(np.int64), return_counts=True), strict=True):
                out["cell", int(cell)] = out.get(("cell", int(cell)), 0.0) + float(n)
        return out

    def calibrate(self, judged: dict[tuple[str, int], float]) -> None:
        """The sharpness of the score under which the true languages are likeliest; the entropy of texts that belong."""
        cells = sorted((at, n) for (what, at), n in judged.items() if what == "cell")
        if not cells:
            return
        self.scale = float(min((-total, at) for (what, at), total in judged.items() if what == "scale")[1])
        upto = np.cumsum([n for _, n in cells])
        self.limit = (cells[int(np.searchsorted(upto, 0.999 * upto[-1]))][0] + 1) / CELLS * MARGIN
        self.slack = 4.0

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        langs, scores, rejected = [], [], []
        for a, b in chunks(texts, 1 << 19):
            if not self.names:
                langs += [UNKNOWN] * (b - a)
                scores.append(np.zeros(b - a))
                rejected.append(np.ones(b - a, bool))
                continue
            h, n = self.entropies(texts[a:b])
            best = h.argmin(axis=1)
            low = h.min(axis=1)
            z = np.exp(-self.scale * (h - low[:, None]))
            scores.append(np.where(n > 0, 1 / z.sum(axis=1), 0.0))
            rejected.append((n == 0) | (low > self.limit + self.slack / np.sqrt(np.maximum(n, 1))))
            langs += [self.names[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist(), strict=True)]
        return langs, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def _met(df: DataFrame) -> DataFrame:
    """A table to join: broadcast if it has so few rows, a few for each language, else met by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def sample(docs: DataFrame, key: str, text: str, lang: str, n: int) -> DataFrame:
    """(lang, text, held): the n documents of each language with the smallest hashes, whole texts, one row for each id.

    Rows without id, text or language are left out. Of an id given more than once the least language and text count.
    """
    place = F.xxhash64("_k", F.lit("sample"))
    rows = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.octet_length(F.col(f"`{text}`")).cast("long").alias("_bytes"))
    rows = rows.where(F.col("_k").isNotNull() & F.col("lang").isNotNull() & (F.col("_bytes") <= EACH)).withColumn("_h", place)
    # a row for each of so many languages
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_k").alias("_c"))
    # hashes are even, so about 3 n ids of a language lie below this bound, however many it has: only those are ranked
    low = rows.join(_met(counts), "lang").where(F.col("_h") / F.lit(float(2**63)) < F.least(F.lit(1.0), 6.0 * n / F.col("_c") - 1))
    low = low.groupBy("_k", "_h").agg(F.min("lang").alias("lang"), F.max("_bytes").alias("_bytes"))
    order = Window.partitionBy("lang").orderBy("_h", "_k")
    first = low.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).withColumn("_sum", F.sum("_bytes").over(order)).where(F.col("_sum") <= SAMPLE_BYTES)
    chosen = first.select("_k", "lang", (F.col("_n") % HELD_BACK == 0).alias("held"))  # n rows a language at most
    return rows.join(_met(chosen), ["_k", "lang"]).groupBy("_k", "lang", "held").agg(F.min("text").alias("text")).select("lang", "text", "held")


_LOW = np.int64((1 << 21) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, n, held) of batches of (lang, held, text): the letters of each n-gram two by two, and its counts in the two parts."""
    pending: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    size = 0

    def whole(lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = (np.concatenate(x, axis=-1) for x in zip(*pending[lang], strict=True))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[:, order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[new], b[new], np.add.reduceat(n, new, axis=1)

    def told() -> Iterator[pa.RecordBatch]:
        for lang in pending:
            a, b, n = whole(lang)
            for i in range(0, len(a), 1 << 16):
                j = min(len(a), i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), j - i), pa.array(a[i:j]), pa.array(b[i:j]), pa.array(n[0, i:j]), pa.array(n[1, i:j])], names=["lang", "a", "b", "n", "held"])

    for batch in batches:
        texts, groups = utf8(batch.column(2)), {}
        for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            groups.setdefault(at, []).append(texts[i])
        for (lang, held), some in groups.items():
            for begin, end in chunks(some):
                for code, n in ngrams(some[begin:end]):
                    wide = code.astype(np.int64)
                    pending.setdefault(lang, []).append((wide[0] << 21 | wide[1], wide[2] << 21 | wide[3], np.stack([n * (not held), n * held]).astype(np.int64)))
                    size += len(n)
            if size > PENDING:
                pending = {lang: [whole(lang)] for lang in pending}
                size = sum(len(x[0][0]) for x in pending.values())
                if size > HELD:
                    yield from told()
                    pending, size = {}, 0
    yield from told()


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The language's models of all its n-grams and of those not held back."""
    a, b = rows.a.to_numpy(), rows.b.to_numpy()
    code = np.stack([a >> 21, a & _LOW, b >> 21, b & _LOW]).astype(np.uint32)
    n, held = rows.n.to_numpy(), rows.held.to_numpy()
    seen = n > 0
    return pd.DataFrame({"lang": rows.lang[:1].tolist(), "model": [KneserNey.of(code, n + held).dump()], "tried": [KneserNey.of(code[:, seen], n[seen]).dump() if seen.any() else None]})


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int | None = None) -> Models:
    """Models of every language of the labelled rows, all of which teach; rows without id, text or language teach nothing.

    With ``sample_docs`` only so many documents of each language do. What one task and the driver hold are the different n-grams of a
    language and of all languages, which grow with what is written in them, not with how often.
    """
    small_batches(labelled.sparkSession)
    if sample_docs is None:
        rows = labelled.select(F.col(f"`{lang}`").alias("lang"), (F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("held")), F.lit(HELD_BACK)) == 0).alias("held"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("_k"))
        rows = rows.where("_k IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").drop("_k")
    else:
        rows = stored(sample(labelled, key, text, lang, sample_docs).select("lang", "held", "text"))
    counts = rows.mapInArrow(_counted, "lang string, a long, b long, n long, held long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    fitted = counts.groupBy("lang").applyInPandas(_fit, "lang string, model binary, tried binary").collect()
    fitted.sort(key=lambda r: r.lang)
    if not fitted:
        models = Models.__new__(Models)
        models.names = []
        return models
    models, tried = Models([r.lang for r in fitted], [bytes(r.model) for r in fitted]), [r for r in fitted if r.tried is not None]
    if tried:
        sent = labelled.sparkSession.sparkContext.broadcast(Models([r.lang for r in tried], [bytes(r.tried) for r in tried]))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = sent.value.judged(utf8(batch.column(1)), batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in told], pa.string()), pa.array([k for _, k in told], pa.int64()), pa.array(list(told.values()), pa.float64())], names=["what", "at", "total"])

        judged = rows.where("held").select("lang", "text").mapInArrow(judge, "what string, at long, total double").groupBy("what", "at").agg(F.sum("total").alias("total"))
        models.calibrate({(r.what, r["at"]): r.total for r in judged.collect()})  # a row for each scale and cell
    return models


def identify(docs: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with lang_pred, score (0 to 1) and rejected; null text, or text without letters, is `und` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # as large as the different n-grams

    def compute(given: pa.Table) -> list:
        langs, scores, rejected = sent.value.predict(utf8(given.column(0)))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return append(docs, fields, compute, [text], keep=keep)


def held_out(key: str = "doc_id") -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    models = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), models, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
