"""Visually identical text with different characters (problem 5).

Frequent spellings form a vocabulary trie. A token with any character out of the ordinary walks it under an edit
automaton in which a look-alike costs nothing and an unseen character is passed over at no cost; of the words it reaches, the most
frequent is the canonical spelling. Tokens that reach none are rewritten by the table of look-alikes. Both ways
give equal results for tokens that look equal, so pages that look equal become equal.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import glyphs
from pagewright.llm.inputs import Once
from pagewright.llm.trie import Trie, weighted
from pagewright.llm.vocabulary import frequent, token_table
from pagewright.operators.pairs import pairs_within
from pagewright.sources.tables import settle, table

_MEMO = 300_000


class Canon:
    """Canonical spellings for one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, int]]):
        words = [(w, n) for w, n in vocabulary if unicodedata.normalize("NFC", w) == w and not any(glyphs.table().get(ord(ch), "") is None for ch in w)]
        self.trie = Trie(words)
        members: dict[str, list[str]] = {}
        for ch in self.trie.letters:
            members.setdefault(self._shape(ch), []).append(ch)
        self.members = members
        # spellings that are not the plainest of their shape, and every token that must move because of them
        self.moved: dict[str, str] = {}
        best: dict[str, tuple[int, str]] = {}
        for w, n in words:
            shape = self._shape(w)
            best[shape] = max(best.get(shape, (0, "")), (n, w))
        for shape, (_, w) in best.items():
            if w != shape:
                self.moved[shape] = w
        self.memo: dict[str, str] = {}

    @staticmethod
    def _shape(text: str) -> str:
        return glyphs.shape(text)

    def _edits(self, token: str, i: int):
        if i == len(token):
            return
        shape = glyphs.table().get(ord(token[i]), token[i])
        if shape is None:
            yield 1, "", 0
            return
        if len(shape) > 1:
            yield 1, shape, 0
            return
        for ch in self.members.get(shape, ()):
            yield 1, ch, 0

    def token(self, token: str) -> str:
        """The canonical spelling of one token without blanks."""
        found = self.memo.get(token)
        if found is None:
            # by what it looks like: composed first, a Cyrillic o with a diaeresis would be no look-alike any more
            shape = self._shape(token)
            reached = weighted(self.trie, shape, self._edits, 0, least=0)
            found = self.trie.words[max(reached, key=lambda k: (self.trie.weight[k], self.trie.words[k]))] if reached else self.moved.get(shape, shape)
            if len(self.memo) > _MEMO:
                self.memo.clear()
            self.memo[token] = found
        return found

    def text(self, text: str) -> str:
        """The canonical form of a text: its tokens in canonical spelling, its blanks plain, its line breaks kept."""
        if not text:
            return ""
        if glyphs._PLAIN.fullmatch(text) and not self.moved:
            return glyphs._ends(text)
        text = re.sub("\xad(?=[^\\S\\n]*(?:\\n|$))", "-", text)
        text = re.sub("\r\n?|[\x0b\x85\u2028\u2029]", "\n", text)
        text = "".join(p if not p or p == "\n" else " " * len(p) if p.isspace() else self._word(p) for p in re.split(r"(\n|[^\S\n]+)", text))
        return glyphs._ends(text)

    def _word(self, word: str) -> str:
        if glyphs._PLAIN.fullmatch(word):
            return self.moved.get(word, word) if self.moved else word
        return self.token(word)


def vocabulary(pages: DataFrame, *texts: str) -> list[tuple[str, int]]:
    """The frequent tokens of all pages in ``texts``, by default ``clean_text``.

    Columns that repeat each other would count a token twice, and one that is divided in either of them once; so it counts as often as in
    the column that holds it most.
    """
    counts = [token_table(pages, text, str.split) for text in texts or ("clean_text",)]
    return frequent(reduce(DataFrame.unionByName, counts).groupBy("token").agg(F.max("n").alias("n")) if len(counts) > 1 else counts[0])


def canonical(df: DataFrame, text: str, keep: list[str], words: list[tuple[str, int]], digest: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``canonical_text``, or with ``digest`` the 128-bit digests ``form`` of the text and ``look`` of its canonical form.

    Each further text column of ``also`` comes out as ``canonical_<column>``; digests are of one text.
    A null text gives nulls, an empty one an empty form.
    """
    if digest and also:
        raise ValueError("digests are of one text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    held = df.sparkSession.sparkContext.broadcast(Once(Canon, words))
    names = ["form", "look"] if digest else ["canonical_text", *(f"canonical_{c}" for c in also)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = held.value.get()
        mark = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        for b in batches:
            columns = []
            for c in b.columns[len(keep) :]:
                texts = c.to_pylist()
                forms = [None if t is None else canon.text(t) for t in texts]
                columns += [[None if t is None else mark(t) for t in x] for x in (texts, forms)] if digest else [forms]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, pa.string()) for c in columns)], names=[*keep, *names])

    return df.select(*keep, *[F.col(c).alias(f"__text{i}") for i, c in enumerate((text, *also))]).mapInArrow(run, fields + "".join(f", {n} string" for n in names))


# ---------------------------------------------------------------- queries


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the canonical forms of its clean_text and its normalized_text, each row once.

    Rows of one page, or of none, whose texts look different all stay. A table without normalized_text gives nulls for its form.
    """
    pages = table(spark, sf_dir, "pages")
    there = "normalized_text" in pages.columns
    pages = pages.select("page_id", "clean_text", (F.col("normalized_text") if there else F.lit(None).cast("string")).alias("normalized_text"))
    words = vocabulary(pages, "clean_text", "normalized_text") if there else vocabulary(pages)
    return canonical(pages, "clean_text", ["page_id"], words, also=("normalized_text",)).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages of at least 200 characters that look the same while their strings differ."""
    pages = table(spark, sf_dir, "pages", "page_id", "clean_text")
    words = vocabulary(pages)
    looks = settle(canonical(pages.filter(F.length("clean_text") >= 200), "clean_text", ["page_id"], words, digest=True).distinct(), "looks")
    return pairs_within(looks, "look", "page_id", "form").distinct()


# ---------------------------------------------------------------- SQL


def _seen_sql(c: str) -> str:
    """The table of look-alikes as a nest of SQL functions; canonical spellings are a finer choice among equals and change no pair."""
    pairs = [(chr(k), v) for k, v in sorted(glyphs.table().items()) if v is not None and len(v) == 1 and chr(k) not in "'\xad" and v != "'"]
    gone = "".join(f"\\x{{{k:x}}}" for k, v in sorted(glyphs.table().items()) if v is None)
    wide = [(chr(k), v) for k, v in sorted(glyphs.table().items()) if v is not None and (len(v) > 1 or v == "'")]
    out = f"regexp_replace({c}, '\\x{{ad}}([ \\t]*(\\n|$))', '-\\1', 'g')"
    for a, b in wide:
        if ord(a) in glyphs.LIGATURES or ord(a) in glyphs.NUMERALS or b == "'":
            out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    out = f"translate({out}, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')"
    out = f"replace(nfc_normalize(regexp_replace({out}, '[{gone}]', '', 'g')), 'ı\u0307', 'i')"
    return f"regexp_replace({out}, '[ \\t]+(\\n|$)', '\\1', 'g')"


def found_sql() -> str:
    return f"""
WITH p AS (SELECT DISTINCT page_id, clean_text FROM pages WHERE length(clean_text) >= 200), s AS (SELECT page_id, clean_text, {_seen_sql("clean_text")} AS look FROM p)
SELECT DISTINCT a.page_id AS page_id_a, b.page_id AS page_id_b FROM s a JOIN s b USING (look) WHERE a.page_id < b.page_id AND a.clean_text <> b.clean_text"""
