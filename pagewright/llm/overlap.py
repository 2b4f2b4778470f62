"""Same or near-same records across splits (problem 6).

Pages meet on pairs of neighbouring words. Two sequences with at least L words in common in order hold at least
3 L - |a| - |b| - 1 pairs of neighbours in common, since a word that only one of them has parts at most one pair of the common words.
Four fifths of the longer one therefore leave two fifths of the pairs, so both hold a common pair among the rarest
three fifths of theirs, whatever order is called rare. Length, place and parity bits of the words, which bound the common words too,
drop most of those that meet; an exact longest common subsequence of words decides. Nothing that reaches four fifths is missed.

For the report the words are also cut into chunks where a rolling hash over two neighbouring words says so, so an inserted or changed
word moves no cut but its own. Chunk digests are joined across splits; the lengths of the chunks a page shares with the other
side give its overlap fraction.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import glyphs
from pagewright.llm.inputs import slug
from pagewright.operators.pairs import pairs_across, spread
from pagewright.sources.tables import settle, table

#: Pages share at least this part of the longer one's words, in order.
SAME = 0.8
LEAST_CHARS = 200
#: A chunk has at least three words and ends where the rolling hash has one value of three, at last after twelve.
SHORTEST, ONE_OF, LONGEST = 3, 3, 12
#: Records whose pairs of words are counted to order pairs by rarity, and pairs that are held for it; no result depends on either.
SAMPLE, HELD = 40_000, 300_000
#: Records of one pair of words that meet in one task, and the part of all records counted at least to tell pairs of very many records.
BLOCK, LEAST_SHARE = 2000, 0.02
#: Parity bits of the words of a record, in 64s.
BITS = 4
_DIVIDED = re.compile(r"(?<=\w)[-‐‑\xad¬=–~][^\S\n]*\n\s*(?=[^\W\d])")
_WORD = re.compile(r"\w+")
_MEMO = 500_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str) -> list[str]:
    """Words as they are compared: look-alikes plain, divided words whole, no case, no punctuation."""
    return _WORD.findall(_DIVIDED.sub("", glyphs.seen(text)).replace("İ", "i").lower())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 … n of the base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def chunks_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests and lengths in words of the content-defined chunks of a sequence of word hashes."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = hashes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        rolled = h * np.uint64(0xFF51AFD7ED558CCD)
        rolled[1:] += h[:-1] * np.uint64(0xC4CEB9FE1A85EC53)
        rolled ^= rolled >> np.uint64(33)
        cuts = np.flatnonzero(((rolled * np.uint64(_BASE)) >> np.uint64(33)) % np.uint64(ONE_OF) == 0)
        ends = [0]
        for c in (cuts + 1).tolist():
            while c - ends[-1] > LONGEST:
                ends.append(ends[-1] + LONGEST)
            if c - ends[-1] >= SHORTEST:
                ends.append(c)
        while n - ends[-1] > LONGEST:
            ends.append(ends[-1] + LONGEST)
        if n - ends[-1] < SHORTEST and len(ends) > 1:
            ends.pop()
        if n > ends[-1]:
            ends.append(n)
        at = np.array(ends)
        up, down = _powers(n)
        # the digest of words s..e is the sum of h[j] * base ** (s - j), from differences of one running sum
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * down[:n], out=total[1:])
        digest = (total[at[1:]] - total[at[:-1]]) * up[at[:-1]]
        digest ^= digest >> np.uint64(29)
        digest *= np.uint64(0xBF58476D1CE4E5B9)
        digest += np.diff(at).astype(np.uint64)
    return digest.view(np.int64), np.diff(at).astype(np.int32)


def page_records(pages: DataFrame) -> DataFrame:
    """``page_id, split, record, n_words, words``; ``record`` is equal for pages of equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            records, counts, words = [], [], []
            for t in b.column(2).to_pylist():
                ws = words_of(t or "")
                ids = []
                for w in ws:
                    h = memo.get(w)
                    if h is None:
                        if len(memo) > _MEMO:
                            memo.clear()
                        h = memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    ids.append(h)
                hs = np.array(ids, np.int64)
                records.append(int.from_bytes(hashlib.blake2b(hs.tobytes(), digest_size=8).digest(), "little", signed=True))
                counts.append(len(ws))
                words.append(hs.astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(records, pa.int64()), pa.array(counts, pa.int32()), pa.array(words, pa.list_(pa.int32()))],
                names=["page_id", "split", "record", "n_words", "words"],
            )

    return pages.select("page_id", "split", "clean_text").mapInArrow(run, "page_id string, split string, record bigint, n_words int, words array<int>")


def chunk_rows(records: DataFrame) -> DataFrame:
    """``record, chunk, length`` of ``records(record, words)``; a chunk that comes again in a record counts with its whole length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, chunks, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for record, words in zip(b.column(0).to_pylist(), _lists(b.column(1))):
                d, n = chunks_of(words.astype(np.int32).view(np.uint32).astype(np.int64))
                if len(d):
                    d, where = np.unique(d, return_inverse=True)
                    owners.append(np.full(len(d), record, np.int64))
                    chunks.append(d)
                    lengths.append(np.bincount(where, n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (owners, chunks, lengths)], names=["record", "chunk", "length"])

    return records.select("record", "words").mapInArrow(run, "record bigint, chunk bigint, length int")


def _neighbours(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, owner of each, pairs of neighbouring words, owner of each, place of each) of the lists of a column."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32).astype(np.uint64), column.offsets.to_numpy()
    at = at - at[0]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    pairs = (flat[inside] << np.uint64(32) | flat[inside + 1]).view(np.int64)
    return flat, owner, pairs, owner[inside], inside - at[owner[inside]]


def frequent_pairs(records: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs of neighbouring words that return in a sample of ``n`` records(record, words), and about how often in all: at most HELD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, counts = np.unique(_neighbours(b.column(0))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], names=["pair", "n"])

    share = min(1.0, max(SAMPLE / max(n, 1), LEAST_SHARE))
    # a record is told by a digest, so its place among all numbers of 64 bits draws the sample
    drawn = records.filter((F.col("record").cast("double") + 2.0**63) / 2.0**64 <= share).select("words")
    counted = drawn.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
    got = counted.orderBy(F.desc("n"), "pair").limit(HELD).toArrow()
    pairs, counts = got["pair"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(pairs)
    return pairs[order], (counts[order] / share).astype(np.int64)


def rare_pairs(records: DataFrame, known: tuple[np.ndarray, np.ndarray], same: float) -> DataFrame:
    """Of ``records(record, train, eval, words)`` the pairs of neighbouring words one of which two records have in common that share ``same`` of the longer one.

    ``pair, record, train, eval, n`` (words), ``rarer`` (places with rarer pairs), ``first`` and ``last`` place, ``blocks`` the pair's records are to be cut into, and
    ``b0 …``: parity bits.
    """
    held = records.sparkSession.sparkContext.broadcast(known)
    bits = [f"b{i}" for i in range(BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times = held.value
        for b in batches:
            flat, of_word, pairs, owner, place = _neighbours(b.column(3))
            n = np.bincount(of_word, minlength=b.num_rows)
            slot = of_word * (64 * BITS) + ((flat * np.uint64(_BASE)) >> np.uint64(40)).astype(np.int64) % (64 * BITS)
            odd = np.bincount(slot, minlength=b.num_rows * 64 * BITS) % 2 == 1
            signs = np.packbits(odd.reshape(b.num_rows, 64 * BITS), axis=1).view(np.int64)
            often = np.zeros(len(pairs), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, pairs), len(names) - 1)
                often = np.where(names[at] == pairs, times[at], 0)
            order = np.lexsort((place, pairs, often, owner))
            pairs, owner, place = pairs[order], owner[order], place[order]
            start = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])]) if len(pairs) else np.zeros(0, np.int64)
            end = np.r_[start[1:], len(pairs)] - 1 if len(start) else start
            who = owner[start]
            rarer = start - (np.cumsum(np.maximum(n - 1, 0)) - np.maximum(n - 1, 0))[who]
            keep = rarer <= 3 * (1 - same) * n[who] + 1e-6
            start, end, who, rarer = start[keep], end[keep], who[keep], rarer[keep]
            blocks = 1 + often[order][start] // BLOCK
            rows = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[start]), *(b.column(i).take(rows) for i in range(3)), *(pa.array(c.astype(np.int32)) for c in (n[who], rarer, place[start], place[end], blocks)), *(pa.array(np.ascontiguousarray(signs[who, i])) for i in range(BITS))],
                names=["pair", "record", "train", "eval", "n", "rarer", "first", "last", "blocks", *bits],
            )

    return records.select("record", "train", "eval", "words").mapInArrow(
        run, "pair bigint, record bigint, train boolean, eval boolean, n int, rarer int, first int, last int, blocks int, " + ", ".join(f"{x} bigint" for x in bits)
    )


def candidates(records: DataFrame, known: tuple[np.ndarray, np.ndarray], same: float) -> DataFrame:
    """``train_record, eval_record``: at least all that share ``same`` of the longer one's words in order, and are not equal."""
    if same < 0.8:
        raise ValueError("below four fifths short records need not have two neighbouring words in common")
    rows = rare_pairs(records, known, same)
    names = [c for c in rows.columns if c not in ("pair", "train", "eval", "blocks")]

    def side(mine: str, other: str) -> DataFrame:
        """One side: each record in the block of its pair its hash gives it, once for each block of the other side; most pairs have one."""
        block = F.pmod(F.xxhash64("record"), F.col("blocks")).cast("int").alias(f"{mine}_block")
        facing = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"{other}_block")
        return rows.filter(mine).select("pair", block, facing, *(F.col(c).alias(f"{mine}_{c}") for c in names))

    left, right = side("train", "eval"), side("eval", "train")
    keys = ["pair", "train_block", "eval_block"]
    tn, en = F.col("train_n"), F.col("eval_n")
    longest = F.greatest(tn, en)
    slack = 1e-6
    differ = sum((F.bit_count(F.col(f"train_b{i}").bitwiseXOR(F.col(f"eval_b{i}"))) for i in range(BITS)), F.lit(0))
    near = (
        (F.col("train_record") != F.col("eval_record"))
        & (F.least(tn, en) >= same * longest - slack)
        # a common word stands at most as many places off as words are left out of one of the two
        & (F.col("train_first") - F.col("eval_last") <= (1 - same) * longest + slack) & (F.col("eval_first") - F.col("train_last") <= (1 - same) * longest + slack)
        # all rarer places are such as the two have not in common
        & (F.col("train_rarer") <= 2 * tn + en - 3 * same * longest + slack) & (F.col("eval_rarer") <= 2 * en + tn - 3 * same * longest + slack)
        # each word only one of them has turns one bit
        & (differ <= tn + en - 2 * same * longest + slack)
    )
    return spread(left, *keys).join(right, keys).filter(near).select("train_record", "eval_record").distinct()


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in one long integer."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _usable(pages: DataFrame) -> DataFrame:
    return pages.filter((F.length("clean_text") >= LEAST_CHARS) & F.col("page_id").isNotNull() & F.col("split").isin("train", "validation", "test"))


def cross_split(pages: DataFrame, same: float = SAME) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, fractions, links)`` of ``pages(page_id, split, clean_text)``.

    ``members(page_id, split, record)``: each usable page with its record; equal pages share one.
    ``fractions(record, fraction)``: the part of a record's words in chunks that the other side holds too.
    ``links(train_record, eval_record)``: records, equal or not, that share at least ``same`` of the longer one's words in order.
    Pages with fewer than 200 characters, a null id or no split take no part; repeated rows count once.
    """
    told = settle(page_records(_usable(pages)), "pages")
    members = told.select("page_id", "split", "record").distinct()
    records = settle(
        told.groupBy("record").agg(F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") != "train").alias("eval"), F.max("n_words").alias("n_words"), F.first("words").alias("words")),
        "records",
    )
    held = chunk_rows(records).join(records.select("record", "train", "eval", "n_words"), "record")
    shared = held.groupBy("chunk").agg(F.max("train").alias("t"), F.max("eval").alias("e")).filter("t and e").select("chunk")
    fractions = held.join(shared, "chunk", "left_semi").groupBy("record").agg((F.sum("length") / F.max("n_words")).alias("fraction"))
    wanted = settle(candidates(records, frequent_pairs(records, records.count()), same), "candidates")
    texts = records.select("record", "words")
    paired = wanted.join(texts.select(F.col("record").alias("train_record"), F.col("words").alias("a")), "train_record").join(
        texts.select(F.col("record").alias("eval_record"), F.col("words").alias("b")), "eval_record"
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(*(_lists(b.column(i)) for i in (2, 3))):
                need = same * max(len(x), len(y)) - 1e-6
                # words in common in any order bound those in common in order
                both = np.isin(x, y).sum() >= need and np.isin(y, x).sum() >= need if len(x) and len(y) else False
                ok.append(bool(both) and common_words(x.tolist(), y.tolist()) >= need)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    near_links = paired.select("train_record", "eval_record", "a", "b").mapInArrow(judge, "train_record bigint, eval_record bigint")
    equal = records.filter("train and eval and n_words > 0").select(F.col("record").alias("train_record"), F.col("record").alias("eval_record"))
    return members, fractions, near_links.unionByName(equal)


def page_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``page_id_a < page_id_b``: the pages of linked records, one of train and one of another split, in blocks."""
    links = links.withColumn("link", F.concat_ws(":", "train_record", "eval_record"))
    train = links.join(members.filter("split = 'train'"), links.train_record == members.record).select("link", "page_id", F.lit("t").alias("side"))
    held = links.join(members.filter("split != 'train'"), links.eval_record == members.record).select("link", "page_id", F.lit("e").alias("side"))
    return pairs_across(train.unionByName(held), "link", "page_id", "side").select("page_id_a", "page_id_b").distinct()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "split", "clean_text")


# ---------------------------------------------------------------- queries


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train page and a page of another split that hold nearly the same words in order."""
    members, _, links = cross_split(_pages(spark, sf_dir))
    return page_pairs(settle(members, "members"), settle(links, "links"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split and source: pages, pages that overlap with the other side, and the chunk fractions they reach."""
    members, fractions, links = cross_split(_pages(spark, sf_dir))
    members, links = settle(members, "members"), settle(links, "links")
    documents = table(spark, sf_dir, "documents", "document_id", "source").dropDuplicates(["document_id"])
    hit = links.select(F.col("train_record").alias("record"), F.lit(True).alias("train")).union(links.select("eval_record", F.lit(False))).distinct()
    each = (
        members.withColumn("train", F.col("split") == "train")
        .join(hit.withColumn("linked", F.lit(True)), ["record", "train"], "left")
        .join(fractions, "record", "left")
        .withColumn("document_id", F.regexp_extract("page_id", r"^(.*)_page_\d+$", 1))
        .join(documents, "document_id", "left")
    )
    return each.groupBy("split", slug(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.coalesce("linked", F.lit(False))).alias("overlapping"),
        F.round(F.avg(F.coalesce("fraction", F.lit(0.0))), 6).alias("mean_fraction"),
    )
