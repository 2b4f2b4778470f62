"""Missing or wrong document language labels (problem 4).

Hierarchical discrimination: linear support vector machines first tell the family of a paragraph (Arabic script, Turkic in
Latin letters, western European), then one machine for each pair of languages of that family votes. All machines are linear in
counts of hashed character n-grams inside words, so a paragraph's scores are sums over its words, and a word
is scored once for each worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import glyphs
from pagewright.llm.inputs import Once, drawn, language_set
from pagewright.llm.residue import residue_documents
from pagewright.sources.tables import settle, table

FAMILIES = {"arabic": ("ar", "ota"), "turkic": ("tr", "ota-latn"), "western": ("de", "en", "fr")}
CODES = tuple(c for cs in FAMILIES.values() for c in cs)
PAIRS = tuple((f, a, b) for f, cs in FAMILIES.items() for a, b in combinations(cs, 2))
MACHINES = len(FAMILIES) + len(PAIRS)
DIMENSIONS = 4096
#: Documents of one label drawn at most to train on, and paragraphs of one language used at most.
SAMPLE = 700
PER_LANGUAGE = 700
#: A piece of text is a whole paragraph when it has at least so many words and letters and ends a sentence; titles do not.
LEAST_WORDS, LEAST_LETTERS = 8, 40
#: A paragraph speaks for another language than the main one of its document with at least this confidence.
SURE = 0.6
_HELD = 300_000
#: Characters of words and of texts worked on together at most, unless one alone is longer.
_TOGETHER = 250_000
_SENTENCE = re.compile(r"[^\W\d_]{3}[,\"'»”’)]*[.?!;؟؛…:]")
_BREAK = re.compile(r"\n(?:[^\S\n]*\n\s*|(?=[^\S\n]{2,}\S))")


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to four characters of each word with its ends marked, word after word, and where those of each word begin.

    The hash is the CRC-32 of the UTF-8 bytes, worked out for all words together: that of n characters goes on from that of n - 1.
    """
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    # the bytes of each character, the first of them marked by the number of bytes
    octets = np.zeros((4, len(points)), np.uint32)
    for n, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        own = length == n
        for k in range(n):
            part = points[own] >> 6 * (n - 1 - k)
            octets[k, own] = part & 0x3F | 0x80 if k else part | mark
    ends = np.cumsum(sizes)
    starts = ends - sizes
    room = np.repeat(ends, sizes) - np.arange(len(points))
    codes = np.zeros((len(points), 4), np.int64)
    there = room[:, None] > np.arange(4)
    crc, at = np.full(len(points), 0xFFFFFFFF, np.uint32), np.arange(len(points))
    for n in range(4):
        inside = there[at, n]
        crc, at = crc[inside], at[inside]
        wide = length[at + n]
        for k in range(int(wide.max(initial=0))):
            crc = np.where(wide > k, _CRC[(crc ^ octets[k, at + n]) & 0xFF] ^ crc >> 8, crc)
        codes[at, n] = (crc ^ np.uint32(0xFFFFFFFF)) % DIMENSIONS
    there[starts, 0] = there[ends - 1, 0] = False
    there[starts[sizes == 2], 1] = False
    per_word = np.add.reduceat(there.sum(1), starts) if len(words) else sizes
    return codes[there], np.cumsum(per_word) - per_word


def bounded(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts, as many as make up ``_TOGETHER`` characters; a longer one alone."""
    size, held = 0, []
    for t in texts:
        if held and size + len(t) > _TOGETHER:
            yield held
            size, held = 0, []
        held.append(t)
        size += len(t)
    if held:
        yield held


def bare(token: str) -> str:
    """The letters of a token as they look, lower-case; empty for figures and signs."""
    token = glyphs.seen(token).replace("İ", "i").lower()
    if token.isalpha():
        return token
    return "".join(ch for ch in token if ch.isalpha() or ch in "-'’̇")


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Start and end of each piece between blank lines, indented lines and page breaks."""
    out, at = [], 0
    pages = text.split("\f")
    for n, page in enumerate(pages):
        a, b = at, at + len(page)
        at = b + 1
        # blanks beside a page break belong to it
        if n:
            a += len(page) - len(page.lstrip())
        if n < len(pages) - 1:
            b -= len(page) - len(page.rstrip())
        for m in _BREAK.finditer(text, a, b):
            if m.start() > a:
                out.append((a, m.start()))
            a = m.end()
        if a < b:
            out.append((a, b))
    return out


@dataclass
class Machines:
    """``weights`` (machines x dimensions), ``bias`` and ``slope`` that turns margins into probabilities."""

    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 0.03, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) by accelerated gradient; y in {-1, 1}; classes weighted to balance."""
    n, d = x.shape
    if n == 0 or abs(y.sum()) == n:
        return np.zeros(d, np.float32), float(np.sign(y.sum())) if n else 0.0
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    scale = float((np.square(x).sum(1) + 1).max())
    step = 1 / (2 * scale + penalty)
    w = v = np.zeros(d, np.float32)
    b = c = 0.0
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * weight * y
        nw = v - step * (penalty * v - 2 * (slack @ x))
        nb = c + step * 2 * float(slack.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw.astype(np.float32), nb, nt
        v = v.astype(np.float32)
    return w, b


def features(texts: list[str]) -> np.ndarray:
    """Mean n-gram counts per word, to unit length scale, one row per paragraph."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    met = Met(bare)
    for i, t in enumerate(texts):
        words = [w for w in map(met.__getitem__, t.split()) if w]
        if words:
            out[i] = sum(np.bincount(grams(part)[0], minlength=DIMENSIONS) for part in bounded(words)) / len(words)
    return out


def fit(x: np.ndarray, labels: np.ndarray) -> Machines:
    """Machines from features and labels: one for each family against the rest, one for each pair inside a family."""
    family = np.array([next((f for f, cs in FAMILIES.items() if c in cs), "") for c in labels], object)
    weights, bias = np.zeros((MACHINES, DIMENSIONS), np.float32), np.zeros(MACHINES)
    slope = np.ones(MACHINES)
    sides = [(np.ones(len(labels), bool), family == f) for f in FAMILIES] + [((labels == a) | (labels == b), labels == a) for _, a, b in PAIRS]
    for k, (own, positive) in enumerate(sides):
        weights[k], bias[k] = train_machine(x[own], np.where(positive[own], 1.0, -1.0).astype(np.float32))
        margins = np.abs(x[own] @ weights[k] + bias[k])
        slope[k] = 3.0 / max(float(np.median(margins)) if len(margins) else 1.0, 1e-3)
    return Machines(weights, bias, slope)


def predict(x: np.ndarray, model: Machines) -> np.ndarray:
    return np.array([CODES[k] for k in decide(x @ model.weights.T + model.bias, model.slope)[0]], object)


def train(rows: list[tuple[str, str]], folds: int = 3) -> Machines:
    """Machines from (language, paragraph) rows with some wrong labels.

    A row stays only if machines that have not seen it agree with its label; the rest trains the machines that are kept.
    Where no row would stay, all do.
    """
    labels = np.array([r[0] for r in rows], object)
    x = features([r[1] for r in rows])
    fold = np.array([zlib.crc32(r[1].encode("utf-8", "surrogatepass")) % folds for r in rows], int)
    agreed = np.zeros(len(rows), bool)
    for k in range(folds):
        held = fold == k
        if held.any() and (~held).any():
            agreed[held] = predict(x[held], fit(x[~held], labels[~held])) == labels[held]
    if not agreed.any():
        agreed[:] = True
    return fit(x[agreed], labels[agreed])


def decide(margins: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into CODES and confidence for each row of margins: the family first, then votes of its pairs."""
    p = 1 / (1 + np.exp(-np.clip(margins * slope, -30, 30)))
    nf = len(FAMILIES)
    fam = margins[:, :nf].argmax(1)
    share = p[:, :nf] / np.maximum(p[:, :nf].sum(1, keepdims=True), 1e-9)
    best, confidence = np.zeros(len(margins), np.int64), np.zeros(len(margins))
    for f, (name, codes) in enumerate(FAMILIES.items()):
        own = fam == f
        if not own.any():
            continue
        votes, sure = np.zeros((own.sum(), len(codes))), np.ones((own.sum(), len(codes)))
        for k, (g, a, b) in enumerate(PAIRS, nf):
            if g == name:
                q, i, j = p[own, k], codes.index(a), codes.index(b)
                votes[:, i] += q > 0.5
                votes[:, j] += q <= 0.5
                sure[:, i] = np.minimum(sure[:, i], q)
                sure[:, j] = np.minimum(sure[:, j], 1 - q)
        pick = (votes + sure * 0.5).argmax(1)
        at = np.arange(len(pick))
        best[own] = [CODES.index(codes[i]) for i in pick]
        confidence[own] = share[own, f] * sure[at, pick]
    return best, confidence


class Met(dict):
    """What ``make`` gives for a key, worked out when the key is first met."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(key)
        return out


class Scorer:
    """Scores of words, each worked out once: tokens of one word share its row, and new words of many texts are scored together."""

    def __init__(self, model: Machines):
        self.model = model
        self.by_gram = np.ascontiguousarray(model.weights.T)
        self.rows: dict[str, int] = Met(lambda token: self.words[bare(token)])
        self.words: dict[str, int] = Met(self._place)
        self.fresh: list[str] = []
        self.table = np.zeros((1024, MACHINES + 2), np.float32)

    def _place(self, word: str) -> int:
        self.fresh.append(word)
        return len(self.words)

    def _score(self) -> None:
        """Fill in the rows of the words met since the last call, which are the last ones."""
        at = len(self.words) - len(self.fresh)
        if len(self.words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(self.fresh)), MACHINES + 2), np.float32)])
        for words in bounded(self.fresh):
            rows = self.table[at : at + len(words)]
            at += len(words)
            rows[:] = 0
            held = np.array([len(w) for w in words])
            if held.any():
                codes, starts = grams([w for w in words if w])
                rows[held > 0, :MACHINES] = np.add.reduceat(self.by_gram[codes], starts, axis=0)
                rows[:, MACHINES], rows[:, MACHINES + 1] = held > 0, held
        self.fresh = []

    def row(self, token: str) -> int:
        """Place of a token's scores in the table."""
        out = self.rows[token]
        self._score()
        return out

    def columns(self, texts: list[str]) -> list[list | np.ndarray]:
        """Of each paragraph of the texts: place of its text, place in it, start, end, index into CODES, confidence, words, letters, whole; -1 for CODES where there is no word."""
        if len(self.rows) > _HELD:
            self.rows.clear()
            self.words.clear()
        owner, place, start, end, ids, ends, get = [], [], [], [], [], [0], self.rows.__getitem__
        for n, text in enumerate(texts):
            for i, (a, b) in enumerate(paragraphs(text)):
                ids.extend(map(get, text[a:b].split()))
                ends.append(len(ids))
                owner.append(n)
                place.append(i)
                start.append(a)
                end.append(b)
        self._score()
        sums = np.concatenate([np.zeros((1, MACHINES + 2)), np.cumsum(self.table[np.array(ids, np.int64)], axis=0, dtype=np.float64)])
        sums = sums[ends[1:]] - sums[ends[:-1]]
        words, letters = np.rint(sums[:, MACHINES]).astype(int), np.rint(sums[:, MACHINES + 1]).astype(int)
        names, sure = decide(sums[:, :MACHINES] / np.maximum(words, 1)[:, None] + self.model.bias, self.model.slope)
        whole = (words >= LEAST_WORDS) & (letters >= LEAST_LETTERS)
        for k in np.flatnonzero(whole).tolist():
            whole[k] = _SENTENCE.search(texts[owner[k]], start[k], end[k]) is not None
        return [owner, place, start, end, np.where(words > 0, names, -1), sure, words, letters, whole]

    def text(self, text: str) -> list[tuple[int, int, int, float, int, int, bool]]:
        """(start, end, index into CODES, confidence, words, letters, whole) of each paragraph; -1 where there is no word."""
        return list(zip(*(c if isinstance(c, list) else c.tolist() for c in self.columns([text])[2:])))


def labelled_sample(documents: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """Paragraphs of at most about ``sample`` documents of each label that names one language, drawn by a hash of doc_id."""
    single = documents.select("doc_id", language_set(F.col("language")).alias("codes"), "text").filter(F.size("codes") == 1).withColumn("code", F.col("codes")[0])
    taken_from = drawn(single.select("doc_id", "code", "text"), "doc_id", "code", sample).select("code", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, part = [], []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # a few paragraphs of each document, evenly over its length: one long document must not fill the sample
                spans = [s for s in paragraphs(t or "") if s[1] - s[0] >= 80]
                for s in spans[:: max(1, -(-len(spans) // 6))]:
                    code.append(c)
                    part.append(t[s[0] : s[1]])
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.string()), pa.array(part, pa.string())], names=["code", "part"])

    taken: dict[str, int] = {}
    rows = []
    for r in sorted(taken_from.mapInArrow(cut, "code string, part string").collect(), key=lambda r: zlib.crc32(r[1].encode("utf-8", "surrogatepass"))):
        if taken.setdefault(r[0], 0) < PER_LANGUAGE:
            taken[r[0]] += 1
            rows.append((r[0], r[1]))
    return rows


def segments(documents: DataFrame, model: Machines) -> DataFrame:
    """One row per paragraph: ``doc_id, segment, start, end, language, confidence, words, letters, whole``.

    Neighbouring pieces stay apart; a piece without any letter has a null language and confidence 0. Null and empty
    texts give no rows; repeated rows are kept as they are.
    """
    held = documents.sparkSession.sparkContext.broadcast(Once(Scorer, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.get()
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
        for b in batches:
            at = 0
            for texts in bounded([t or "" for t in b.column(1).to_pylist()]):
                docs = b.column(0).slice(at, len(texts))
                at += len(texts)
                owner, place, start, end, code, sure, *rest = scorer.columns(texts)
                names = [CODES[k] if k >= 0 else None for k in code.tolist()]
                columns = [place, start, end, names, np.where(code >= 0, sure, 0.0), *rest]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["doc_id", "segment", "start", "end", "language", "confidence", "words", "letters", "whole"],
                )

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, segment int, start int, `end` int, language string, confidence double, words int, letters int, whole boolean"
    )


def document_languages(parts: DataFrame) -> DataFrame:
    """From segments: ``doc_id, language, confidence, languages``.

    ``languages`` is the sorted array of those in which a whole paragraph is written; ``language`` the one with most letters,
    with the mean confidence of its paragraphs weighted by letters. A document without any paragraph long
    enough is judged by all its pieces and gets an empty array.
    """
    each = parts.filter(F.col("language").isNotNull()).groupBy("doc_id", "language").agg(
        F.sum("letters").alias("letters"), F.sum(F.when(F.col("whole"), F.col("letters")).otherwise(0)).alias("whole_letters"),
        F.coalesce(F.max(F.when(F.col("whole"), F.col("confidence"))), F.lit(0.0)).alias("surest"),
        (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"),
    )
    rank = F.struct("whole_letters", "letters", "language")
    found = each.groupBy("doc_id").agg(
        F.max_by("language", rank).alias("language"), F.max_by("confidence", rank).alias("confidence"),
        F.collect_list(F.when(F.col("whole_letters") > 0, F.struct("language", "surest"))).alias("all"),
    )
    kept = F.filter("all", lambda x: (x["surest"] >= SURE) | (x["language"] == F.col("language")))
    return found.select("doc_id", "language", "confidence", F.array_sort(F.transform(kept, lambda x: x["language"])).alias("languages"))


def trained(documents: DataFrame) -> Machines:
    """Machines trained on a sample of the documents themselves."""
    return train(labelled_sample(documents))


# ---------------------------------------------------------------- queries


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and all languages of every document; null, 0 and none of one without a letter."""
    documents = table(spark, sf_dir, "documents", "doc_id", "language", "text")
    # repeated rows weigh all paragraphs of a document alike and change nothing
    found = document_languages(segments(documents, trained(documents)))
    every = table(spark, sf_dir, "documents", "doc_id").distinct().join(found, "doc_id", "left")
    return every.select("doc_id", "language", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.array_join("languages", ","), F.lit("")).alias("languages"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in another language than most of their document."""
    documents = table(spark, sf_dir, "documents", "doc_id", "language", "text")
    parts = settle(segments(documents, trained(documents)), "segments")
    main = document_languages(parts).select("doc_id", F.col("language").alias("main"))
    return parts.join(main, "doc_id").filter(F.col("whole") & (F.col("confidence") >= SURE) & (F.col("language") != F.col("main"))).select("doc_id", "segment", "start", "end", "language", "confidence", "main").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages really present of documents whose label does not name exactly these."""
    documents = table(spark, sf_dir, "documents", "doc_id", "language", "text", "n_chars", "source", "filename", "display_title", "pdf_title", "work")
    wanted = documents.filter("n_chars >= 200")
    found = document_languages(segments(wanted, trained(documents)))
    # where no piece is a whole paragraph, the language of the pieces together stands
    found = found.withColumn("languages", F.when(F.size("languages") > 0, F.col("languages")).otherwise(F.array("language")))
    labels = wanted.select("doc_id", language_set(F.col("language")).alias("named")).dropDuplicates(["doc_id"])
    # a response may return mostly in documents too short to be wanted
    residue = residue_documents(documents).filter("is_residue").select("doc_id")
    wrong = found.join(labels, "doc_id").filter((F.size("languages") > 0) & (F.col("languages") != F.col("named")))
    return wrong.join(residue, "doc_id", "left_anti").select("doc_id", F.explode("languages").alias("language"))
