"""Noise in text from scanned pages (problem 1).

The tokens of all pages, divided words joined, give a vocabulary trie. Every distinct token that is no word is intersected with it once,
under a weighted Levenshtein automaton: letters that a reader machine takes for other characters are cheap edits, any other
substitution, insertion or deletion a dear one. Every vocabulary word within the bound is a candidate. Candidates are ranked by cost, by
how often they stand beside the neighbouring words anywhere in the corpus, and by frequency; a word that only a dear edit reaches
counts as misread only where its neighbours speak for it. Tokens left without a candidate are joined with the counts of all
tokens on every word they may be a cheap misreading of. Page furniture is told by place, shape, the titles and authors of the volume
and by its return on other pages; what is left is reflowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.fold import fold_letters, py_fold
from pagewright.llm import glyphs
from pagewright.llm.inputs import Once
from pagewright.llm.residue import kind_of
from pagewright.llm.trie import Trie, weighted
from pagewright.llm.vocabulary import LEAST, floor_of, pair_key, token_and_pair_table
from pagewright.operators.pairs import spread
from pagewright.sources.tables import settle, table

# Letters and what scanning software reads in their place.
CONFUSIONS = {
    "e": ("c",), "a": ("@",), "i": ("1", "|", "!", "l"), "l": ("1", "|"), "n": ("ri",), "d": ("cl",), "t": ("†",), "s": ("5", "$"),
    "m": ("rn", "nn", "iii"), "k": ("lc", "1c"), "o": ("0",), "h": ("li",), "g": ("9",), "b": ("6",), "ü": ("ii",), "u": ("ii", "li"), "ş": ("§",), "ö": ("6", "0"), "w": ("vv",), "z": ("2",), "q": ("9",),
    "B": ("8",), "E": ("3",),
    "ا": ("l", "|", "1"), "ر": ("j",), "و": ("9",), "د": ("5",), "ن": ("u",), "ه": ("o",), "م": ("p",), "س": ("w",), "ع": ("e",), "ل": ("j",), "ی": ("s",), "ي": ("s",),
}
_BY_OUTPUT: dict[str, list[tuple[str, str]]] = {}
for _letter, _outs in CONFUSIONS.items():
    for _o in _outs:
        _BY_OUTPUT.setdefault(_o[0], []).append((_o, _letter.lower()))
#: Costs of a confusion and of any other edit, and the cost that two confusions have: no plain edit is among what costs less.
CONFUSION, PLAIN, SOUND = 2, 5, 4
#: Letters from which on a token may hold a plain edit, and a confusion besides.
ONE_PLAIN, ONE_MORE = 4, 8
#: Confusions a misread word may hold where only confusions are tried.
BOUND = 2
#: A vocabulary word is this much more frequent than its misreadings.
RATIO = 3
CLEAN_RATIO = 20
#: A word that only a plain edit reaches must stand at least so often beside the neighbours of the misread one.
NEAR = 2
#: Lines at the head, and at the foot, that may be furniture.
EDGE = 3
#: A token of more characters is no word of any language; it is neither counted nor judged.
LONGEST = 64
# Letters of Arabic script that differ in their dots only.
_SKELETONS = ("بتثپن", "جحخچ", "دذ", "رزژ", "سش", "صض", "طظ", "عغ", "فق", "کكگ", "یيى")
_DOTLESS = str.maketrans({ch: group[0] for group in _SKELETONS for ch in group})

MODEL_TOKENS = re.compile(r"<\|ref\|>.*?<\|/ref\|>(?:\s*<\|det\|>\[\[.*?\]\]<\|/det\|>)?|<\|det\|>.*?<\|/det\|>|<\|/?[A-Za-z_]+\|>", re.S)
_SIGNS = "-‐‑\xad¬=–~⸗"
DIVIDED = re.compile(rf"([^\W\d_][\wʿʾ'’-]*)([{_SIGNS}])[^\S\n]*\n[^\S\n]*((?=[^\W\d_])[\wʿʾ'’]+)")
_TOKEN = re.compile(r"[^\s.,;:?!()\[\]«»\"“”…،؛؟—/<>{}%~=¬]+")
_SYMBOL = re.compile(r"[0-9@†§|!$£¥&#]|[a-z](?=[ء-ي])|(?<=[ء-ي])[a-z]")
_LETTERS = re.compile(r"[^\W\d_]")
_HEX = re.compile(r"[0-9a-f]{6,}")
_PARTS = re.compile(r"\s/\s|\s\|\s|\s[—–·•]\s|\s{3,}")
_SENTENCE_END = re.compile(r"[^\W\d_]{3}[,\"'»”’)]*[.?!;؟؛…]\s*$")

# Numbers as pages print them, words that stand before them, and words of chapter headings.
_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = rf"(?:\d{{1,4}}|{_ROMAN})"
PAGE_LINE = re.compile(rf"[\s\-–—~*·•(\[<|]*(?:(?:sayfa|sahife|ṣaḥīfe|ṣaḥife|sahīfe|page|pages|seite|pagina|صفحة|صحیفه|صفحه|ص|pp?|s|sh|ss)\s*\.?\s*)?{_NUMBER}\s*(?:/\s*\d+)?[\s\-–—~*·•)\]>|.]*", re.I)
_WITH_NUMBER = re.compile(r"^\s*(?:(?P<before>\d{1,4})\s{2,}(?=\S)|(?P<text>.*?\S)\s{2,}(?P<after>\d{1,4})\s*$)")
HEADINGS = re.compile(r"\b(bolum\w*|kisim|fasil|fasl|bab|mukaddime|onsoz|giris|sonuc|hatime|chapter|part|book|preface|introduction|appendix|chapitre|partie|livre|avant propos|kapitel|teil|abschnitt|vorwort|einleitung|anhang)\b|الفصل|الباب|فصل|باب|مقدمه|مقدمة|خاتمة|خاتمه")


def lower(text: str) -> str:
    return text.replace("İ", "i").lower()


def bare(token: str) -> str:
    """A token without the signs around it; a bar may be a letter misread, and goes only where it stands on both sides."""
    token = token.strip("-'’*_")
    return token.strip("|") if token[:1] == "|" == token[-1:] else token


def fold_i(word: str) -> str:
    """Dotless i counts as i, since capitals do not tell them apart."""
    return word.replace("ı", "i")


def surface_tokens(raw: str) -> list[str]:
    """Lower-case tokens of a raw page as the vocabulary counts them: markers of the model dropped, divided words joined."""
    text = lower(glyphs.seen(MODEL_TOKENS.sub(" ", raw)))
    return [w for t in _TOKEN.findall(DIVIDED.sub(_join, text)) if (w := bare(t))]


def _join(m: re.Match) -> str:
    # a hyphen before a single vowel is the written izafet of a compound
    return f"{m[1]}-{m[3]}" if m[2] in "-‐‑" and m[3] in ("i", "ı", "yi", "yı") else m[1] + m[3]


def confusion_edits(token: str, i: int):
    """Transitions of the automaton: a letter as it is, or a letter that was read as what stands here."""
    if i < len(token):
        yield 1, token[i], 0
        for seen, letter in _BY_OUTPUT.get(token[i], ()):
            if token.startswith(seen, i):
                yield len(seen), letter, 1


def scan_edits(token: str, i: int):
    """The same with plain edits beside it: any letter for any other, left out or put in."""
    for used, text, cost in confusion_edits(token, i):
        yield used, text, CONFUSION * cost
    if i < len(token):
        yield 1, None, PLAIN
        yield 1, "", PLAIN
    yield 0, None, PLAIN


def bound_of(token: str) -> int:
    """The greatest cost of a candidate: two confusions, from ONE_PLAIN letters on one plain edit, from ONE_MORE on with a confusion."""
    n = len(token)
    return SOUND if n < ONE_PLAIN else PLAIN if n < ONE_MORE else PLAIN + CONFUSION


def skeleton(word: str) -> str:
    """A word without accents and dots: where these are all that differs, it is a spelling and no misreading."""
    return py_fold(word).translate(_DOTLESS)


class Lexicon:
    """The vocabulary in a worker: its trie, and candidates of tokens."""

    def __init__(self, known: dict[str, tuple[int, str]]):
        self.known = known
        self.trie = Trie((w, n) for w, (n, _) in known.items())

    def near(self, token: str, plain: bool = True) -> list[tuple[str, int]]:
        """(word, cost) of every vocabulary word within the bound, but the token itself."""
        if plain:
            reached = weighted(self.trie, token, scan_edits, bound_of(token), CONFUSION)
        else:
            reached = {k: CONFUSION * c for k, c in weighted(self.trie, token, confusion_edits, BOUND).items()}
        words = self.trie.words
        found = [(words[k], c) for k, c in reached.items() if words[k] != token]
        if any(c > SOUND for _, c in found):
            bones = skeleton(token)
            found = [(w, c) for w, c in found if c <= SOUND or skeleton(w) != bones]
        return found


class Words:
    """The vocabulary: folded word -> (count, most frequent surface), and what is known of frequent tokens that are no words.

    ``told`` holds tokens as frequent as words: the word each is a misreading of, or None where it is none.
    """

    def __init__(self, counted: list[tuple[str, int]], floor: int | None = None):
        known: dict[str, tuple[int, str, int]] = {}
        for surface, n in counted:
            if is_plain(surface):
                w = fold_i(surface)
                total, best, most = known.get(w, (0, surface, 0))
                known[w] = (total + n, surface if n > most else best, max(n, most))
        self.known = {w: (n, s) for w, (n, s, _) in known.items()}
        self.floor = floor if floor is not None else min((n for n, _ in self.known.values()), default=1)
        self._misread: frozenset[str] | None = None
        self.told: dict[str, str | None] = {w: None for w in map(fold_i, (c[0] for c in counted)) if w not in self.known}

    def drop(self, wrong: Iterable[str]) -> None:
        """Take frequent misreadings of far more frequent words out of the vocabulary."""
        for w in wrong:
            if self.known.pop(w, None):
                self.told[w] = None

    def misread(self) -> frozenset[str]:
        """The frequent tokens that are misreadings."""
        if self._misread is None:
            self._misread = frozenset(w for w, word in self.told.items() if word)
        return self._misread

    def divided(self, left: str, sign: str, right: str) -> bool:
        """Whether a word before and after a sign at a line end is one divided word, and no compound with its hyphen."""
        if sign not in "-‐‑":
            return True
        joined, compound = fold_i(left + right), fold_i(f"{left}-{right}")
        j, c = self.known.get(joined, (0, ""))[0], self.known.get(compound, (0, ""))[0]
        if j or c:
            return j >= c
        return not (right in ("i", "ı", "yi", "yı") or len(left) > 3 and len(right) > 3 and fold_i(left) in self.known and fold_i(right) in self.known)


def is_plain(word: str) -> bool:
    """Whether a token can be a word: letters of one alphabet and no sign that stands for a letter."""
    return bool(_LETTERS.search(word)) and not re.search(r"[\d@†§|!$£¥&#%_\\^`]", word) and not _mixed(word)


def sources_of(token: str) -> set[str]:
    """Every plain word the automaton takes a folded token for, other than itself."""
    out, seen = set(), {}
    stack = [(0, "", 0)]
    while stack:
        i, made, cost = stack.pop()
        if seen.get((i, made), BOUND + 1) <= cost:
            continue
        seen[i, made] = cost
        if i == len(token):
            if made != token and is_plain(made):
                out.add(made)
            continue
        stack += [(i + used, made + text, cost + extra) for used, text, extra in confusion_edits(token, i) if cost + extra <= BOUND]
    return out


def _mixed(word: str) -> bool:
    return bool(re.search(r"[ء-ي]", word)) and bool(re.search(r"[a-z]", word))


def looks_misread(token: str) -> bool:
    """Whether a token of letters holds one or two signs no word has, such as figures inside a name."""
    if len(_LETTERS.findall(token)) < 3 or _HEX.fullmatch(token) or re.search(r"[_\\^`%+*]", token):
        return False
    signs = _SYMBOL.findall(token)
    return 0 < len(signs) <= 2 and not re.search(r"\d{2}", token) and token[0] not in "#$&!"


def edge_lines(lines: list[str]) -> list[int]:
    """Indices of up to EDGE lines with text at the head and as many at the foot."""
    full = [i for i, t in enumerate(lines) if t.strip()]
    return sorted({*full[:EDGE], *full[-EDGE:]})


def is_page_number(line: str) -> bool:
    """Whether a line is nothing but a printed page number in any dress."""
    line = line.strip()
    return bool(line) and len(line) < 24 and bool(PAGE_LINE.fullmatch(line)) and any(ch.isdigit() or ch in "ivxlcIVXLC" for ch in line)


@lru_cache(20_000)
def title_key(text: str) -> str:
    """Letters of a line or title for comparison: folded, spaced letters closed, no figures and signs."""
    return re.sub(r"[^a-zء-يک-ی]", "", py_fold(glyphs.seen(text)))


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)):
        return False
    # distance by one row of the table
    bound = max(len(a), len(b)) // 4
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > bound:
            return False
    return row[-1] <= bound


def names_of(titles: list[str | None], authors: list[str | None], filename: str | None) -> list[str]:
    """Keys of a volume's titles and author as headers may print them."""
    out = set()
    for t in titles:
        if t:
            plain = re.sub(r"\([^)]*\)|[,;]\s*(vol|c|cilt|bd|t|tome)\b\.?.*$", " ", t, flags=re.I)
            out |= {title_key(t), title_key(plain)}
    for a in authors:
        if a:
            plain = re.sub(r"\([^)]*\)|\b(dr|prof|doç|mr|mrs|herr|frau|mme|sir)\b\.?", " ", a, flags=re.I)
            out |= {title_key(plain)}
            if "," in plain:
                last, _, first = plain.partition(",")
                out |= {title_key(first + last)}
    if filename and not re.match(r"(?i)(scan|belge|tarama|doc|img|file|document)[_\- ]?\d", filename):
        out |= {title_key(re.sub(r"(_?\d+)?\.\w+$", "", filename))}
    return sorted(k for k in out if len(k) >= 5)


def repeats_name(line: str, names: list[str]) -> bool:
    """Whether a line is the title, the author or both."""
    key = title_key(line)
    if len(key) < 5:
        return False
    for n in names:
        if _alike(key, n):
            return True
        if n in key and len(key) <= 1.6 * len(n) + 12:
            for rest in names:
                if rest != n and _alike(key.replace(n, "", 1), rest):
                    return True
            if len(key) <= 1.25 * len(n):
                return True
    return any(len(p) >= 5 and any(_alike(p, n) for n in names) for p in map(title_key, _PARTS.split(line)) if p != key)


def may_name(line: str, longest: int) -> bool:
    """Whether a line is short enough to hold a name of at most ``longest`` letters, as ``repeats_name`` judges lines."""
    most = 1.6 * longest + 12
    return len(line) <= most or len(title_key(line)) <= most or any(len(title_key(p)) <= 1.34 * longest for p in _PARTS.split(line)[1:])


def styled(line: str) -> bool:
    """Whether a line is set like a running title: capitals, spaced letters, between signs, beside a number or author / title."""
    t = line.strip()
    if not t or _SENTENCE_END.search(t):
        return False
    core = re.sub(r"^[\W\d]+|[\W\d]+$", "", t)
    if len(_LETTERS.findall(core)) < 5:
        return False
    words = core.split()
    capitals = core == core.upper() and core != core.lower() and len(words) <= 40 and not re.search(r"[ء-ي]", core)
    between = bool(re.fullmatch(r"([~*=·•]).+\1", t))
    named = all(w[:1].isupper() for w in words if len(w) > 4)
    beside = len(words) <= 7 and named and bool(_WITH_NUMBER.match(t))
    pair = " / " in t and named and len(words) <= 14
    if not (capitals or between or beside or pair):
        return False
    folded = py_fold(t)
    return not HEADINGS.search(folded) and not kind_of(t, folded)


def titled(line: str) -> bool:
    """Whether a line is a few words that all begin with a capital, but short ones, as names and titles do."""
    words = re.sub(r"^[\W\d]+|[\W\d]+$", "", line).split()
    return 0 < len(words) <= 8 and words[0][:1].isupper() and all(w[:1].isupper() for w in words if len(w) > 4)


UNSURE = "array<struct<token: string, left: string, right: string, name: boolean>>"
EDGES = f"array<struct<place: int, foot: int, text: string, number: boolean, styled: boolean, sentence: boolean, misread: boolean, unsure: {UNSURE}>>"


def page_notes(pages: DataFrame, words: Words, longest: int) -> DataFrame:
    """What one look at each page tells: ``page_id, document_id, line_hyphen, misread, unsure, edges``.

    ``misread`` (a token that no word can be) and ``unsure`` (rare unknown tokens with the tokens beside them) of the page tell of
    lines between the edges, each edge line tells of its own; ``place`` counts lines with text from the head (0, 1, …) and ``foot`` from the
    foot (-1, -2, …). ``longest``: letters of the longest title or author. Null and empty texts give false and no edges.
    """
    held = pages.sparkSession.sparkContext.broadcast(words)
    unknown = pa.list_(pa.struct([*((k, pa.string()) for k in ("token", "left", "right")), ("name", pa.bool_())]))
    kind = pa.list_(pa.struct([("place", pa.int32()), ("foot", pa.int32()), ("text", pa.string()), *((k, pa.bool_()) for k in ("number", "styled", "sentence", "misread")), ("unsure", unknown)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [note(raw or "", held.value, longest) for raw in b.column(2).to_pylist()]
            columns = [pa.array([t[i] for t in told], k) for i, k in enumerate((pa.bool_(), pa.bool_(), unknown, kind))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["page_id", "document_id", "line_hyphen", "misread", "unsure", "edges"])

    return pages.select("page_id", "document_id", "raw_text").mapInArrow(run, f"page_id string, document_id string, line_hyphen boolean, misread boolean, unsure {UNSURE}, edges {EDGES}")


def any_misread(text: str, words: Words) -> tuple[bool, list[dict]]:
    """Whether a stretch of running text holds what no word can be or a frequent misreading; and its rare unknown tokens.

    ``name`` tells of those that begin with a capital.
    """
    known, told, found = words.known, words.told, False
    shown = [w for t in _TOKEN.findall(text) if (w := bare(t))]
    tokens = fold_i(lower("\n".join(shown))).split("\n") if shown else []
    unsure = {}
    for i, w in enumerate(tokens):
        if w not in known and 1 < len(w) <= LONGEST and _LETTERS.search(w):
            if w in told:
                found = found or told[w] is not None or looks_misread(w)
                continue
            found = found or looks_misread(w)
            near = (w, tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else "", shown[i][:1].isupper())
            unsure[near] = dict(zip(("token", "left", "right", "name"), near))
    return found, list(unsure.values())


def note(raw: str, words: Words, longest: int) -> tuple[bool, bool, list[dict], list[dict]]:
    """(divided word, misread between the edges, unknown tokens there, edge lines) of one page."""
    shown = glyphs.seen(MODEL_TOKENS.sub("", raw))
    if not shown.strip():
        return False, False, [], []
    small = lower(shown)
    hyphen = any(words.divided(m[1], m[2], m[3]) for m in DIVIDED.finditer(small) if not is_page_number(small[m.start(3) :].split("\n", 1)[0]))
    lines = shown.split("\n")
    full = [i for i, t in enumerate(lines) if t.strip()]
    edges = []
    skip = set()
    for i in edge_lines(lines):
        t = lines[i]
        number = is_page_number(t)
        own = not number and styled(t)
        sentence = bool(_SENTENCE_END.search(t))
        if number or own or may_name(t, longest):
            skip.add(i)
            place = full.index(i)
            wrong, unsure = (False, []) if number else any_misread(t, words)
            edges.append({"place": place, "foot": place - len(full), "text": t, "number": number, "styled": own, "sentence": sentence, "misread": wrong, "unsure": unsure})
    body = "\n".join("" if i in skip else t for i, t in enumerate(lines))
    return hyphen, *any_misread(DIVIDED.sub(_join, body), words), edges


def decide_furniture(edges: list[dict], names: list[str], back: set[int]) -> list[tuple[bool, bool]]:
    """(running title, page number) for each edge line of a page; ``back`` are the places of lines that return on other pages of the volume.

    A line counts only as part of an unbroken row of furniture from the head or the foot.
    """
    out = [(False, False)] * len(edges)
    by_place = {e[side]: k for side in ("place", "foot") for k, e in enumerate(edges)}
    for places in ((0, 1, 2), (-1, -2, -3)):
        for p in places:
            k = by_place.get(p)
            if k is None:
                break
            e = edges[k]
            heading = bool(HEADINGS.search(py_fold(e["text"])))
            if e["number"]:
                out[k] = (False, True)
                continue
            m = _WITH_NUMBER.match(e["text"])
            title = not heading and (repeats_name(e["text"], names) or e["styled"] or titled(e["text"]) and not e["sentence"] and e["place"] in back)
            if title:
                out[k] = (True, bool(m))
                continue
            if heading and p >= 0 and not e["sentence"]:
                continue
            break
    return out


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, titles, authors, filename`` of every volume, once."""
    d = table(spark, sf_dir, "documents", "document_id", "display_title", "pdf_title", "work", "author", "filename")
    return d.select("document_id", F.array("display_title", "pdf_title", "work").alias("titles"), F.array("author").alias("authors"), "filename").dropDuplicates(["document_id"])


def candidates(tokens: DataFrame, words: Words, plain: bool = True) -> DataFrame:
    """``token, own, word, surface, cost, weight, sole`` of ``tokens(word, n)``: the candidates of every token that is no word.

    Each is RATIO times as frequent as the token. With ``plain`` false words are judged too, by confusions alone.
    """
    held = tokens.sparkSession.sparkContext.broadcast(Once(Lexicon, words.known))
    names = ["token", "own", "word", "surface", "cost", "weight", "sole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value.get()
        for b in batches:
            rows = []
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(t) < 2 or not _LETTERS.search(t) or plain and t in lexicon.known:
                    continue
                found = [(w, c, *lexicon.known[w]) for w, c in lexicon.near(t, plain)]
                found = [(t, n, w, s, c, k) for w, c, k, s in found if k >= RATIO * n]
                rows += [(*f, len(found) == 1) for f in found]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return tokens.select("word", "n").mapInArrow(run, "token string, own bigint, word string, surface string, cost int, weight bigint, sole boolean")


def second_look(tokens: DataFrame, counts: DataFrame, wrong: DataFrame) -> DataFrame:
    """``token, word, surface, n``: the word outside the vocabulary that a token of ``tokens(token)`` is a misreading of.

    Of all ``counts(word, n, surface)`` a word that occurs LEAST times and RATIO times as often as the token and is no misreading itself
    (``wrong(token)``) is a source; the most frequent one is taken. Joined by word, so the counts need not fit anywhere.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(t, n, w) for t, n in zip(*(c.to_pylist() for c in b.columns)) for w in sources_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["token", "own", "word"])

    # what is never counted as a token is the part of a word divided at an edge line, and what holds no letter a number
    own = tokens.filter(F.col("token").rlike(r"\p{L}")).join(counts.select(F.col("word").alias("token"), F.col("n").alias("own")), "token")
    reached = own.mapInArrow(spread, "token string, own bigint, word string").join(counts.filter(F.col("n") >= LEAST), "word").filter(F.col("n") >= RATIO * F.col("own"))
    sound = reached.join(wrong.select(F.col("token").alias("word")), "word", "left_anti")
    return sound.groupBy("token").agg(F.max_by(F.struct("word", "surface", "n"), F.struct("n", "word")).alias("s")).select("token", "s.*")


def _beside(left: Column, right: Column) -> Column:
    return F.when((left != "") & (right != ""), pair_key(left, right))


def mends_of(notes: DataFrame, counts: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``page_id, mends array<struct<token, word>>``: the unknown tokens of each page that are misread, and the word of each.

    Of the candidates ``found`` of a token the one with the least score is taken: its cost, less for every doubling of how
    often it stands beside the token's neighbours (``pairs``), less for frequency. One that takes a plain edit needs NEAR such
    occurrences, and a token in lower case: a rare word with a capital is a name. A token that occurs as often as a word never comes here, so no key of the joins holds more than a small share of the rows.
    """
    each = settle(notes.select("page_id", F.explode(F.array_distinct(F.concat("unsure", F.flatten("edges.unsure")))).alias("u")).select("page_id", "u.*"), "unsure")
    hits = settle(each.join(found, "token"), "hits")
    clear = F.col("sole") & (F.col("cost") <= SOUND)
    plain = hits.filter(clear).select("page_id", "token", F.col("surface").alias("word"), F.lit(0.0).alias("score"))
    open_ = hits.filter(~clear).withColumn("beside", F.array(_beside(F.col("left"), F.col("word")), _beside(F.col("word"), F.col("right"))))
    asked = open_.select("token", "left", "right", "name", "word", "surface", "cost", "weight", F.explode("beside").alias("pair"), "page_id")
    told = asked.join(pairs, "pair", "left").groupBy("page_id", "token", "left", "right", "name", "word", "surface", "cost", "weight").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("near"))
    score = F.col("cost") - 2 * F.log2(1.0 + F.col("near")) - F.log10(F.col("weight").cast("double"))
    ranked = told.filter((F.col("cost") <= SOUND) | ((F.col("near") >= NEAR) & ~F.col("name"))).select("page_id", "token", F.col("surface").alias("word"), score.alias("score"))
    wrong = found.filter(F.col("cost") <= SOUND).select("token").distinct()
    rest = each.select("page_id", "token").distinct().join(wrong, "token", "left_anti")
    rare = rest.join(second_look(rest.select("token").distinct(), counts, wrong), "token").select("page_id", "token", F.col("surface").alias("word"), (F.lit(float(SOUND)) - F.log10(F.col("n").cast("double"))).alias("score"))
    best = plain.unionByName(ranked).unionByName(rare).groupBy("page_id", "token").agg(F.min_by("word", F.struct("score", "word")).alias("word"))
    return best.groupBy("page_id").agg(F.collect_list(F.struct("token", "word")).alias("mends"))


def judge_edges(notes: DataFrame, books: DataFrame, mends: DataFrame) -> DataFrame:
    """Notes with ``running_header, page_number, misread`` of each page and ``furniture``, the places of furniture lines.

    Edge lines are short; the text of pages is not moved. A line returns when its letters stand at the edge of two or more
    pages of a volume.
    """
    rows = notes.select("page_id", "document_id", F.explode("edges").alias("e")).filter("not e.number and not e.sentence")
    letters = F.regexp_replace(fold_letters(F.col("e.text")), "[^a-zء-يک-ی]", "")
    rows = rows.select("page_id", "document_id", F.col("e.place").alias("place"), letters.alias("letters")).filter(F.length("letters") >= 5)
    again = rows.groupBy("document_id", "letters").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).filter("lo != hi").select("document_id", "letters")
    back = rows.join(again, ["document_id", "letters"], "left_semi").groupBy("page_id").agg(F.collect_set("place").alias("back"))
    joined = notes.join(mends, "page_id", "left").join(back, "page_id", "left").join(books, "document_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            header, number, misread, places = [], [], [], []
            known: dict[tuple, list[str]] = {}
            for r in b.to_pylist():
                edges = r["edges"] or []
                about = (*(r["titles"] or []), *(r["authors"] or []), r["filename"])
                if about not in known:
                    known[about] = names_of(r["titles"] or [], r["authors"] or [], r["filename"])
                found = decide_furniture(edges, known[about], set(r["back"] or [])) if edges else []
                header.append(any(f[0] for f in found))
                number.append(any(f[1] for f in found))
                bad = {m["token"] for m in r["mends"] or []}
                wrong = lambda x: x["misread"] or any(u["token"] in bad for u in x["unsure"] or [])  # noqa: B023, E731
                misread.append(bool(wrong(r) or any(wrong(e) for e, f in zip(edges, found) if not any(f))))
                places.append([e["place"] for e, f in zip(edges, found) if any(f)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(header, pa.bool_()), pa.array(number, pa.bool_()), pa.array(misread, pa.bool_()), pa.array(places, pa.list_(pa.int32()))],
                names=["page_id", "line_hyphen", "running_header", "page_number", "misread", "furniture"],
            )

    return joined.select("page_id", "line_hyphen", "misread", "edges", "titles", "authors", "filename", "back", "unsure", "mends").mapInArrow(
        run, "page_id string, line_hyphen boolean, running_header boolean, page_number boolean, misread boolean, furniture array<int>"
    )


def repair(raw: str, furniture: list[int], words: Words, mends: dict[str, str] | None = None) -> tuple[str, int, int]:
    """(continuous paragraphs, words joined, words repaired) of one page, the furniture at the given places left out; ``mends``: token -> word."""
    lines = glyphs.seen(MODEL_TOKENS.sub("", raw)).split("\n")
    full = [i for i, t in enumerate(lines) if t.strip()]
    out = {full[p] for p in furniture if -len(full) <= p < len(full)}
    text = "\n".join("" if i in out else t for i, t in enumerate(lines))
    joined = 0

    def join(m: re.Match) -> str:
        nonlocal joined
        whole = words.divided(lower(m[1]), m[2], lower(m[3]))
        joined += whole
        return m[1] + ("" if whole else "-") + m[3]

    text = DIVIDED.sub(join, text)
    dotted = bool(re.search("[ğışĞİŞ]", text))
    repaired = 0

    def mend(m: re.Match) -> str:
        nonlocal repaired
        core = bare(m[0])
        small = fold_i(lower(core))
        word = None if len(small) < 2 or small in words.known else (mends or {}).get(small) or words.told.get(small)
        if word is None:
            return m[0]
        repaired += 1
        if core[:1].isupper():
            word = ("İ" if word[0] == "i" and dotted else word[0].upper()) + word[1:]
        return m[0].replace(core, word, 1)

    # most pages hold nothing to mend
    if mends or words.misread() and not words.misread().isdisjoint(map(bare, _TOKEN.findall(fold_i(lower(text))))):
        text = _TOKEN.sub(mend, text)
    paragraphs = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n[^\S\n]*\n|\n(?=[^\S\n]{2,}\S)", text)]
    return "\n\n".join(p for p in paragraphs if p), joined, repaired


def vocabulary(pages: DataFrame) -> tuple[Words, DataFrame, DataFrame, DataFrame]:
    """``(words, counts, pairs, found)`` of all raw pages: the vocabulary, ``counts(word, n, surface)`` of all tokens, ``pairs(pair, n)`` of neighbouring ones and the candidates of each that is no word.

    The vocabulary is made of tokens that make up a fixed share of all, so it is bounded; only of these anything comes to the driver.
    """
    both = settle(token_and_pair_table(pages, "raw_text", surface_tokens, fold_i, LONGEST), "tokens")
    surfaces = both.filter(F.col("token").isNotNull()).select("token", "n")
    pairs = both.filter(F.col("pair").isNotNull()).select("pair", "n")
    floor = floor_of(surfaces)
    words = Words([(r[0], r[1]) for r in surfaces.filter(F.col("n") >= floor).collect()], floor)
    counts = settle(surfaces.groupBy(F.translate("token", "ı", "i").alias("word")).agg(F.sum("n").alias("n"), F.max_by("token", F.struct("n", "token")).alias("surface")), "counts")
    often = counts.filter(F.col("n") >= floor)
    # a frequent misreading of a far more frequent word is no word
    wrong = candidates(often, words, plain=False).filter(F.col("weight") >= CLEAN_RATIO * F.col("own"))
    words.drop(r[0] for r in wrong.select("token").distinct().collect())
    # the counts are small and the automaton is not: left as they were written they would be a task or two
    found = settle(candidates(spread(counts, "word"), words), "candidates")
    frequent = found.filter((F.col("own") >= floor) & (F.col("cost") <= SOUND)).groupBy("token").agg(F.min_by("surface", F.struct("cost", -F.col("weight"), "word")).alias("word"))
    words.told |= {r[0]: r[1] for r in frequent.collect()}
    return words, counts, pairs, found


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Words, DataFrame]:
    """(notes, volumes, words, mends) of the pages of a folder."""
    pages = table(spark, sf_dir, "pages", "page_id", "document_id", "raw_text").filter("page_id is not null")
    words, counts, pairs, found = vocabulary(pages)
    books = volumes(spark, sf_dir)
    names = F.greatest(*[F.max(F.length(c)) for c in ("display_title", "pdf_title", "work", "author", "filename")])
    # a compatibility form may show as up to three letters
    longest = 3 * (table(spark, sf_dir, "documents", "display_title", "pdf_title", "work", "author", "filename").agg(names).first()[0] or 0)
    notes = settle(page_notes(pages, words, longest).dropDuplicates(["page_id"]), "notes")
    return notes, books, words, settle(mends_of(notes, counts, pairs, found), "mends")


# ---------------------------------------------------------------- queries


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page and kind of defect in its raw_text."""
    notes, books, _, mends = _notes(spark, sf_dir)
    each = judge_edges(notes, books, mends)
    kinds = ["line_hyphen", "misread", "running_header", "page_number"]
    return each.select("page_id", F.explode(F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())).alias("defect")).distinct()


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs: ``page_id, text, joined, repaired, furniture_lines``."""
    notes, books, words, mends = _notes(spark, sf_dir)
    places = judge_edges(notes, books, mends).select("page_id", "furniture")
    pages = table(spark, sf_dir, "pages", "page_id", "raw_text").filter("page_id is not null").dropDuplicates(["page_id"])
    held = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [repair(t or "", f or [], held.value, {x["token"]: x["word"] for x in m or []}) for t, f, m in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32()), pa.array([len(f or []) for f in b.column(2).to_pylist()], pa.int32())],
                names=["page_id", "text", "joined", "repaired", "furniture_lines"],
            )

    return pages.join(places, "page_id").join(mends, "page_id", "left").select("page_id", "raw_text", "furniture", "mends").mapInArrow(run, "page_id string, text string, joined int, repaired int, furniture_lines int")
