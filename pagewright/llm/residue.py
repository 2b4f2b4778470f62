"""Template residue and error-page text (problem 9).

Each document's address slug, title and body terms are compared, and its lines are tried for unfilled fields, filler,
failure messages and demands for scripts. Of every document whose body shares no term with its slug and title the other lines are counted over all
documents: a line that returns under many titles at several hosts, or under very many at one, is a response whatever its wording. A body is of low
information as far as it consists of such lines and of those the detectors know.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from re import _parser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.fold import fold_text, py_fold
from pagewright.llm.inputs import slug
from pagewright.sources.tables import settle, table

# Ways templates write an unfilled field. One of the first kind marks a line; of the second,
# which prose uses too, it takes two, or one that makes up most of the line.
SURE_FIELD = re.compile(
    r"\{\{\s*[\w .-]+\s*\}\}|\$\{\s*[\w .-]+\s*\}|#\{\s*[\w .-]+\s*\}|\{%\s*[\w .-]+\s*%\}|<%=?\s*[\w .-]+\s*%>|%[A-Za-z_]{3,}%"
    r"|@@[\w.-]+@@|\[\[\s*[\w .-]+\s*\]\]|__[A-Za-z][A-Za-z_]*[A-Za-z]__|<insert [\w .-]+ here>|\[[\w .-]+ giriniz\]|\[(?:insert|enter|your) [\w .-]+\]"
)
MAYBE_FIELD = re.compile(r"\[[A-Za-zçğıöşüÇĞİÖŞÜ_]{3,}\]|<[A-Za-zçğıöşüÇĞİÖŞÜ_]{3,}>|\{[A-Za-zçğıöşüÇĞİÖŞÜ_]{3,}\}|«[A-Za-zçğıöşüÇĞİÖŞÜ_]{3,}»")

# Filler words and stock filler phrases (folded).
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt "
    "mollit anim id est laborum".split()
)
FILLER_PHRASES = re.compile(
    r"\b(your (text|content|title) (goes )?here|(sample|dummy|placeholder|example) text( goes here)?|text goes here|insert text here"
    r"|buraya (metin|icerik|yazi) gelecek|ornek (paragraf|metin|yazi)( metni)?|icerik hazirlaniyor|metin gelecek|yakinda eklenecek"
    r"|texte a venir|texte d ?exemple|faux texte|((blindtext|platzhalter|beispieltext|mustertext) ?)+|bla bla|asdf|qwer(ty)?|xxx+( xxx+)*|test test|deneme( \d+)? deneme)\b"
)

# Failure messages, and demands for scripts, a newer browser or a human check (folded, apostrophes dropped).
FAILURE = re.compile(
    r"\bnot found\b|\bcould not be (loaded|served|found|opened|displayed|retrieved|reached)\b|\bno longer (exists|available)\b|\bhas (been )?(moved|removed|deleted)\b|\bbeen (moved|removed|deleted)\b"
    r"|\b(requires|need|have) (you )?to (sign|log) in\b|\b(is|are) (currently )?(not available|unavailable)\b|\bunavailable\b|\btemporarily\b|\baccess\b.*\b(denied|forbidden)\b|\b(\d{3}|page is|file is) forbidden\b|^\W*forbidden\b|\btoo many requests\b|\bdid not (answer|respond)\b"
    r"|\btimed? ?out\b|\bcrashed while\b|\bgo back or reload\b|\b(server|gateway|internal|unexpected) (server )?error\b|\bbad gateway\b|\bsession (has )?expired\b|\bsomething went wrong\b|\btry again\b|\bno permission\b|\berror \d{3}\b"
    r"|\bbulunamadi\b|\byuklenemi?yor\b|\byuklenemedi\b|\bkaldirilmis\b|\byetkiniz yok\b|\bizniniz yok\b|\bzaman asimi\w*\b|\bsunucu\w*\b.*\b(hata\w*|yok|redde\w+)\b|\bhata\w* olustu\b|\bgiris yapin\b|\boturumunuz\w*\b|\bsonra (tekrar )?deneyin\b|\bhata \d{3}:|\berisilemi?yor\b|\bgosterilemi?yor\b|\bgoruntulenemi?yor\b"
    r"|\bintrouvable\b|\bnest pas (disponible|accessible)\b|\bn est pas disponible\b|\b(a|ont) ete (deplace|supprime)e?s?\b|\bacces (refuse|interdit)\b|\berreur \d{3}\b|\bsession expiree\b|\breessayer\b|\bindisponible\b"
    r"|\bnicht (gefunden|erreichbar|verfugbar|geladen)\b|\b(wurde|wurden) (verschoben|entfernt|geloscht)\b|\bzugriff verweigert\b|\bfehler \d{3}\b|\bsitzung (ist )?abgelaufen\b|\berneut versuchen\b|\bexistiert nicht\b"
    r"|\b(down|closed) for maintenance\b|\bhttp (status |error )?[45]\d\d\b|\bbakim (calismasi|nedeniyle)\b"
)
DEMAND = re.compile(
    r"\bjavascript\b|\bscripts? (enabled|allowed|on)\b|\b(cookies|scripts) (and|enabled|must)\b|\b(enable|allow|activate|turn on) (javascript|scripts?|cookies)\b|\bchecking your browser\b|\b(browser|version) (is )?(not supported|outdated|unsupported)\b|\b(update|upgrade) your browser\b"
    r"|\b(you are|youre) (a )?(human|not a robot)\b|\bnot a robot\b|\bverify (that )?you\b|\bcaptcha\b|\bscripts allowed\b"
    r"|\bbetikler\w*\b.*\b(acma\w*|etkin\w*|acin\w*|izin)\b|\btarayici\w* (desteklenmi?yor|guncel\w*)|\binsan oldugunuz\w*\b|\brobot olmad\w*\b|\bcerezler\w*\b.*\b(acin\w*|etkin\w*)\b"
    r"|\bactive[rz]\b.*\b(javascript|scripts)\b|\bnavigateur\b.*\b(obsolete|pas pris|mettre a jour)\b|\bvous etes humain\b|\bpas un robot\b|\baktivieren sie\b|\bbrowser (wird nicht|ist veraltet|aktualisieren)\b|\bkein roboter\b|\bmensch sind\b"
)
#: Rows of a counted table that may be broadcast.
MOST_BROADCAST = 200_000
MARKS = re.compile(r"[{}<>\[\]%@«»]|__")
WORDS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
#: A line that returns is a response under so many titles at several hosts, or under ONE_HOST times as many at one; it has LEAST_TERMS words.
MIN_TITLES, ONE_HOST, LEAST_TERMS = 5, 3, 3


def has_field(line: str) -> bool:
    """Whether a line holds an unfilled field."""
    if not MARKS.search(line):
        return False
    if SURE_FIELD.search(line):
        return True
    maybe = MAYBE_FIELD.findall(line)
    return len(maybe) >= 2 or bool(maybe) and 2 * len(maybe[0]) > len(line.strip())


def is_filler(folded: str) -> bool:
    """Whether a folded line is filler: stock words, a stock phrase, or one short phrase again and again."""
    words = WORDS.findall(folded)
    known = _stock_words(words)
    if known is not None:
        return known
    if FILLER_PHRASES.search(folded):
        hit = sum(len(m.group()) for m in FILLER_PHRASES.finditer(folded))
        return 2 * hit >= len(folded.strip()) or len(set(words)) <= 4
    return _repeats(words)


def _stock_words(words: list[str]) -> bool | None:
    """Whether the words of a line are filler by its stock words; None where these do not decide."""
    if not words:
        return False
    if 2 * sum(w in FILLER_WORDS for w in words) > len(words) and (len(words) < 3 or len(set(words) & FILLER_WORDS) >= 2):
        return len(words) >= 3 or bool({"lorem", "ipsum", "adipiscing", "consectetur", "eiusmod"} & set(words))
    return None


def _repeats(words: list[str]) -> bool:
    """Whether the words of a line are one to four words again and again."""
    for unit in range(1, 5):
        if len(words) >= max(4, 2 * unit) and all(w == words[i % unit] for i, w in enumerate(words)):
            return True
    return False


def kind_of(line: str, folded: str) -> str | None:
    """``field``, ``filler``, ``failure``, ``demand`` or None for one line."""
    if has_field(line):
        return "field"
    if is_filler(folded):
        return "filler"
    if DEMAND.search(folded):
        return "demand"
    if FAILURE.search(folded):
        return "failure"
    return None


def masked(folded: str) -> str:
    """A line without its numbers and reference codes, so that one response looks alike everywhere."""
    return re.sub(r"\W+", " ", re.sub(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+", "#", folded)).strip()


def needed(pattern: str) -> frozenset[str]:
    """Literals, one of which stands in every match of a pattern; read off the parsed pattern, so they cover every alternative.

    Of what a sequence holds one after the other, the literals whose shortest is longest are taken. Raises ValueError where
    a pattern can match without any literal.
    """
    out = _needed(list(_parser.parse(pattern)))
    if not out:
        raise ValueError(f"no literal stands in every match of {pattern}")
    return out


def _needed(parts: list) -> frozenset[str]:
    found, run = [], ""
    for op, value in parts:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if op is _parser.AT:  # takes no room, so the literals on both sides touch
            continue
        found.append(frozenset({run} - {""}))
        run = ""
        if op is _parser.BRANCH:
            each = [_needed(list(p)) for p in value[1]]
            found.append(frozenset().union(*each) if all(each) else frozenset())
        elif op is _parser.SUBPATTERN:
            found.append(_needed(list(value[-1])))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            found.append(_needed(list(value[2])))
        elif op is _parser.IN and all(o is _parser.LITERAL for o, _ in value):
            found.append(frozenset(chr(v) for _, v in value))
    found.append(frozenset({run} - {""}))
    return max(found, key=lambda s: min(map(len, s), default=0))


@lru_cache(1)
def _screen():
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for word in frozenset().union(*(needed(p.pattern) for p in (MARKS, FILLER_PHRASES, FAILURE, DEMAND))):
        a.add_word(word)
    a.make_automaton()
    return a


def _held(folded: str) -> list[bool]:
    """For each line of a folded text, whether it holds a literal that a field mark, a phrase, a message or a demand needs."""
    out = [False] * (folded.count("\n") + 1)
    line = at = 0
    for end, _ in _screen().iter(folded):
        line += folded.count("\n", at, end)
        at = end
        out[line] = True
    return out


def screened_lines(text: str) -> list[str]:
    """The lines of a text that hold a literal one of the patterns needs, found in one pass over the folded text."""
    return [line for line, held in zip(text.split("\n"), _held(py_fold(text))) if held]


def judged_lines(text: str) -> Iterator[tuple[str, str, list[str], str | None]]:
    """``(line, folded line, its words, kind)`` of every line of a text that is not blank, with the kind ``kind_of`` gives.

    A line without any literal the patterns need can only be filler by its words: two different stock words, or at most four
    words again and again.
    """
    text = text.replace("\f", "")
    folded, letters = fold_text(text)
    for line, small, own, held in zip(text.split("\n"), folded.split("\n"), letters.split("\n"), _held(folded)):
        words = own.split()
        if held:
            if line.strip():
                yield line, small, words, kind_of(line, small)
        elif words:
            # without a literal no phrase stands in it
            if (len(words) < 3 or len(FILLER_WORDS.intersection(words)) >= 2) and (known := _stock_words(words)) is not None:
                yield line, small, words, "filler" if known else None
            else:
                yield line, small, words, "filler" if len(words) >= 4 and len(set(words[:5])) <= 4 and _repeats(words) else None
        elif line.strip():
            yield line, small, words, None


def kinds_of(text: str) -> Iterator[tuple[str, str, str | None]]:
    """The same without the words."""
    return ((line, small, kind) for line, small, _, kind in judged_lines(text))


def response_key(folded: str, words: list[str]) -> int | None:
    """64 bits that tell a line by its words, without its numbers and codes; None for one of fewer than LEAST_TERMS words, which any text may hold."""
    if _DIGIT.search(folded):
        words = WORDS.findall(masked(folded))
    if len(words) < LEAST_TERMS:
        return None
    return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def document_evidence(documents: DataFrame) -> DataFrame:
    """One row per document with its marked characters by kind, and the other lines of bodies that match neither slug nor title.

    ``doc_id, source, n, field, filler, failure, demand, mismatch, title``, and ``keys`` and ``chars`` of the lines, two arrays. Every line of every text is
    judged, and every body is compared with its slug and title, whatever its length.
    """
    names = ["field", "filler", "failure", "demand"]
    schema = "doc_id bigint, source string, n bigint, " + ", ".join(f"`{k}` bigint" for k in names) + ", mismatch boolean, title string, keys array<bigint>, chars array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            keys, sizes, ends = array("q"), array("i"), array("i", [0])
            for doc, source, filename, title, text in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                chars = dict.fromkeys(names, 0)
                terms = {w for w in WORDS.findall(py_fold(f"{filename or ''} {title or ''}".replace("_", " "))) if len(w) > 3 and w != "pdf"}
                rest = []
                for line, folded, words, kind in judged_lines(text):
                    if kind:
                        chars[kind] += len(line)
                    else:
                        rest.append((folded, words, len(line)))
                mismatch = all(terms.isdisjoint(w) for _, w, _ in rest)
                for f, w, n in rest if mismatch else ():
                    if (key := response_key(f, w)) is not None:
                        keys.append(key)
                        sizes.append(n)
                ends.append(len(keys))
                out.append((doc, source, len(text), *(chars[k] for k in names), mismatch, py_fold(title or filename or "")))
            columns = list(zip(*out)) if out else [[] for _ in range(9)]
            types = [pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * 4, pa.bool_(), pa.string()]
            lists = [pa.ListArray.from_arrays(pa.array(np.array(ends)), pa.array(np.array(v))) for v in (keys, sizes)]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, types)), *lists], names=["doc_id", "source", "n", *names, "mismatch", "title", "keys", "chars"])

    title = F.coalesce(F.col("display_title"), F.col("pdf_title"), F.col("work"))
    return documents.select("doc_id", slug(F.col("source")).alias("source"), "filename", title.alias("title"), "text").mapInArrow(run, schema)


def residue_documents(documents: DataFrame, min_titles: int = MIN_TITLES) -> DataFrame:
    """``doc_id, source, n_chars, bad_chars, repeated_chars, kind, is_residue`` for every document.

    A document is residue when more than half of its characters belong to lines that hold an unfilled field, filler,
    a failure message or a demand, or that are responses: lines of bodies that match neither slug nor title, which numbers aside appear
    under at least ``min_titles`` titles at several hosts, or under ONE_HOST times as many titles. Null and empty texts
    are no residue; repeated rows count once.
    """
    each = settle(document_evidence(documents), "residue")
    lines = each.filter("size(keys) > 0").select("doc_id", F.xxhash64("title").alias("title"), F.xxhash64("source").alias("host"), F.explode(F.arrays_zip("keys", "chars")).alias("s"))
    lines = lines.select("doc_id", "title", "host", F.col("s.keys").alias("key"), F.col("s.chars").alias("chars"))
    # a line under several titles stands in as many rows; what returns is little, and only of it the titles are counted
    back = settle(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("lo"), F.max("title").alias("hi")).filter((F.col("n") >= min_titles) & (F.col("lo") != F.col("hi"))).select("key"), "back")
    lines = settle(lines.join(F.broadcast(back) if back.count() <= MOST_BROADCAST else back, "key", "left_semi"), "lines")
    # counted by title first, so a line all documents share moves once per task and title; several hosts show in the least and the greatest
    responses = (
        lines.groupBy("key", "title").agg(F.min("host").alias("lo"), F.max("host").alias("hi"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("titles"), (F.min("lo") != F.max("hi")).alias("spread"))
        .filter((F.col("titles") >= min_titles) & (F.col("spread") | (F.col("titles") >= ONE_HOST * min_titles)))
        .select("key")
    )
    repeated = lines.join(responses, "key", "left_semi").groupBy("doc_id").agg(F.sum("chars").alias("repeated_chars"))
    kinds = ["field", "filler", "failure", "demand"]
    known = sum((F.col(k) for k in kinds), F.lit(0))
    once = each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("source", "n", *kinds)])
    return (
        once.join(repeated, "doc_id", "left")
        .withColumn("repeated_chars", F.expr("coalesce(repeated_chars, 0) div copies"))
        .withColumn("bad_chars", known + F.col("repeated_chars"))
        .select(
            "doc_id", "source", F.col("n").alias("n_chars"), "bad_chars", "repeated_chars",
            F.when(F.col("bad_chars") > 0, F.array_max(F.array(*[F.struct(F.col(k).alias("c"), F.lit(k).alias("k")) for k in kinds], F.struct(F.col("repeated_chars").alias("c"), F.lit("repeated").alias("k"))))["k"]).alias("kind"),
            (F.col("bad_chars") * 2 > F.col("n")).alias("is_residue"),
        )
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source", "filename", "display_title", "pdf_title", "work", "text")


# ---------------------------------------------------------------- queries


def p9_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what was found in it."""
    return residue_documents(_documents(spark, sf_dir))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay after exclusion."""
    return p9_marked(spark, sf_dir).filter("not is_residue").select("doc_id", "source", "n_chars")


def p9_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, residue and its kinds by delivering source."""
    return p9_marked(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("is_residue").alias("residue"),
        *[F.count_if(F.col("is_residue") & (F.col("kind") == k)).alias(k) for k in ("field", "filler", "failure", "demand", "repeated")],
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are residue."""
    return p9_marked(spark, sf_dir).filter("is_residue").select("doc_id")
