"""Splits that keep related records together (problem 2).

Records and the authors and works they name form a graph; its connected components, found by
alternating large-star and small-star rounds, are the smallest sets that may not be divided. A hash of the
component identifier, uniform over [0, 1), falls into the split whose range of the proportions holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.fold import fold_letters
from pagewright.operators.components import connected_components
from pagewright.operators.pairs import pairs_across
from pagewright.sources.tables import settle, table

#: Rows of a checked table that may be broadcast.
MOST_BROADCAST = 200_000
PROPORTIONS = (("train", 0.9), ("validation", 0.05), ("test", 0.05))

# Words that fill an author or work field without naming anyone or anything (folded).
NAMELESS = (
    "unknown", "unknown author", "author unknown", "anonymous", "anon", "anonim", "bilinmiyor", "belirsiz", "yazari belirsiz",
    "yazari bilinmiyor", "yazar yok", "mechul", "muellifi mechul", "la edri", "isimsiz", "adsiz", "basliksiz", "untitled",
    "no title", "no author", "sans titre", "sans auteur", "ohne titel", "ohne verfasser", "unbekannt", "inconnu", "anonyme",
    "na", "n a", "nn", "n n", "sn", "s n", "sl", "s l", "nd", "n d", "sine nomine", "yy", "y y", "none", "null", "nil", "yok",
    "tbd", "test", "xxx", "various", "various authors", "muhtelif", "cesitli", "divers", "collectif", "diverse", "misc", "author", "title", "yazar", "eser",
)
TITLES = ("dr", "prof", "doc", "mr", "mrs", "ms", "sir", "herr", "frau", "mme", "mlle", "monsieur", "madame", "bay", "bayan", "ord", "yrd")


def _plain(c: Column) -> Column:
    """Folded letters and digits, all else a blank, parenthesised parts and years dropped."""
    text = F.regexp_replace(fold_letters(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    text = F.regexp_replace(text, r"\b1[0-9]{3}\b(\s*[-–—]\s*(1[0-9]{3}|20[0-9]{2})?)?|\b20[0-9]{2}\b", " ")
    return text


def _named(key: Column) -> Column:
    return F.when((F.length(key) > 0) & ~key.isin(*NAMELESS) & key.rlike(r"\p{L}{2}"), key)


def author_name(author: Column) -> Column:
    """``given … surname`` of one author field in plain letters; null where it names nobody."""
    text = _plain(author)
    text = F.when(
        F.size(F.split(text, ",")) == 2, F.concat_ws(" ", F.split(text, ",")[1], F.split(text, ",")[0])
    ).otherwise(text)
    text = F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")
    text = F.regexp_replace(text, rf"\b({'|'.join(TITLES)})\b", " ")
    return _named(F.trim(F.regexp_replace(text, r" +", " ")))


def author_key(name: Column) -> Column:
    """Surname and first initial of a name, so that initials and full given names meet."""
    parts = F.split(name, " ")
    surname = F.element_at(parts, -1)
    return F.when(F.size(parts) > 1, F.concat(surname, F.lit(" "), F.substring(name, 1, 1))).otherwise(surname)


def work_key(work: Column) -> Column:
    """Plain letters of a title without volume numbers, quotes and brackets; null where it names nothing."""
    text = _plain(work)
    text = F.regexp_replace(text, r"[,;:.\s]+(vol|volume|cilt|c|bd|band|tome|t|cuz|kisim|part|no)\b\.?\s*([0-9]+|[ivxl]+)\b\.?", " ")
    text = F.regexp_replace(text, r"[,;:\s]+[0-9]+\s*\.?\s*(cilt|band|tome|volume|cuz|kisim)\b", " ")
    return _named(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def entity_links(documents: DataFrame) -> DataFrame:
    """``(node, entity, name)``: each document with each author and work it names.

    Null, blank and nameless fields give no row. Columns beside doc_id, author and work are not looked at.
    """
    named = documents.select("doc_id", author_name(F.col("author")).alias("a"), work_key(F.col("work")).alias("w"))
    entities = F.filter(
        F.array(
            F.when(F.col("a").isNotNull(), F.struct(F.concat(F.lit("a:"), author_key(F.col("a"))).alias("entity"), F.col("a").alias("name"))),
            F.when(F.col("w").isNotNull(), F.struct(F.concat(F.lit("w:"), F.col("w")).alias("entity"), F.col("w").alias("name"))),
        ),
        lambda x: x.isNotNull(),
    )
    return named.select(F.col("doc_id").alias("node"), F.explode(entities).alias("e")).select("node", "e.entity", "e.name")


def split_links(documents: DataFrame) -> DataFrame:
    """``(node, entity)`` for components: works, authors by given name and surname, and, where one author is told by an initial alone, all it may stand for.

    Two full given names of one surname and initial are different people and are not tied unless an initial ties them.
    """
    links = entity_links(documents)
    given = F.split("name", " ")[0]
    author = F.col("entity").startswith("a:")
    short = links.filter(author & (F.length(given) <= 1)).select("entity").distinct()
    # few surnames come with an initial only; beyond the bound the planner sorts both sides
    short = F.broadcast(short) if short.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else short
    tied = links.filter(author).join(short, "entity", "left_semi").select("node", "entity")
    own = links.filter(~author | (F.length(given) > 1)).select("node", F.when(author, F.concat_ws(" ", "entity", given)).otherwise(F.col("entity")).alias("entity"))
    return own.unionByName(tied)


def split_of(component: Column, proportions=PROPORTIONS) -> Column:
    """The split whose cumulative range of the proportions holds the hash of the component, 32 bits of its SHA-256."""
    at = F.conv(F.substring(F.sha2(component.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    total, edge, ladder = sum(p for _, p in proportions), 0.0, None
    for name, share in proportions[:-1]:
        edge += share / total
        ladder = F.when(at < edge, name) if ladder is None else ladder.when(at < edge, name)
    last = proportions[-1][0]
    return F.lit(last) if ladder is None else ladder.otherwise(last)


def assign_splits(documents: DataFrame, proportions=PROPORTIONS) -> DataFrame:
    """``(doc_id, component, split)`` for every document; related documents share both.

    The split is told by the component alone, so it is the same whatever else the table holds. Proportions are met as closely as whole components
    allow; ``p2_shares`` tells how closely. Documents that name nobody and nothing stand
    alone; repeated rows count once; an empty table gives an empty result.
    """
    alone = documents.select(F.col("doc_id").alias("node"), F.lit(None).cast("string").alias("entity"))
    found = connected_components(split_links(documents).unionByName(alone))
    return found.select(F.col("node").alias("doc_id"), "component", split_of(F.col("component"), proportions).alias("split"))


def document_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, split)`` as the pages carry it now."""
    pages = table(spark, sf_dir, "pages", "document_id", "split").dropna().distinct()
    return table(spark, sf_dir, "documents", "document_id", "doc_id").dropna().distinct().join(pages, "document_id").select("doc_id", "split")


# ---------------------------------------------------------------- queries


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component and its new split."""
    return assign_splits(table(spark, sf_dir, "documents", "doc_id", "author", "work"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, components, largest component, share reached and share wanted of each new split."""
    each = p2_splits(spark, sf_dir).groupBy("split", "component").agg(F.count(F.lit(1)).alias("n"))
    each = settle(each.groupBy("split").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest_component")), "shares")
    wanted = F.create_map(*[F.lit(x) for pair in PROPORTIONS for x in pair])
    total = each.agg(F.sum("documents")).first()[0] or 1
    return each.withColumn("share", F.round(F.col("documents") / total, 6)).withColumn("target_share", wanted[F.col("split")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose pages lie in different splits although they name the same author or work.

    Only components that reach into more than one split are looked into; of these, each entity pairs its
    documents across splits in blocks. Two full given names with one initial are different people.
    """
    documents = table(spark, sf_dir, "documents", "doc_id", "author", "work")
    links = settle(entity_links(documents).distinct(), "links")
    components = connected_components(links.select("node", "entity"))
    now = settle(document_splits(spark, sf_dir).distinct(), "now")
    leaky = (
        components.join(now, components.node == now.doc_id)
        .groupBy("component")
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        .filter("lo != hi")
        .select("component")
    )
    inside = components.join(leaky, "component", "left_semi").select("node")
    members = links.join(inside, "node", "left_semi").join(now, links.node == now.doc_id).select("entity", "doc_id", "split", "name")
    pairs = pairs_across(members, "entity", "doc_id", "split", extra=("name",))
    given = lambda c: F.split(F.col(c), " ")[0]
    same = (
        F.col("entity").startswith("w:")
        | (given("name_a") == given("name_b"))
        | (F.least(F.length(given("name_a")), F.length(given("name_b"))) <= 1)
    )
    return pairs.filter(same).select("doc_id_a", "doc_id_b").distinct()


# ---------------------------------------------------------------- SQL

_TITLES_SQL = "|".join(TITLES)
_NAMELESS_SQL = ", ".join(f"'{x}'" for x in NAMELESS)


def _plain_sql(c: str) -> str:
    folded = f"lower(regexp_replace(strip_accents(replace(replace({c}, 'ı', 'i'), 'İ', 'i')), '[\\p{{M}}\\p{{Cf}}ʿʾ’‘''`´]', '', 'g'))"
    text = f"regexp_replace({folded}, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g')"
    return f"regexp_replace({text}, '\\b1[0-9]{{3}}\\b(\\s*[-–—]\\s*(1[0-9]{{3}}|20[0-9]{{2}})?)?|\\b20[0-9]{{2}}\\b', ' ', 'g')"


def _named_sql(c: str) -> str:
    return f"CASE WHEN length({c}) > 0 AND {c} NOT IN ({_NAMELESS_SQL}) AND regexp_matches({c}, '\\p{{L}}{{2}}') THEN {c} END"


LINKS_SQL = f"""
raw AS (SELECT doc_id, {_plain_sql("author")} AS a, {_plain_sql("work")} AS w FROM documents),
turned AS (SELECT doc_id, CASE WHEN len(string_split(a, ',')) = 2 THEN string_split(a, ',')[2] || ' ' || string_split(a, ',')[1] ELSE a END AS a,
  regexp_replace(regexp_replace(w, '[,;:.\\s]+(vol|volume|cilt|c|bd|band|tome|t|cuz|kisim|part|no)\\b\\.?\\s*([0-9]+|[ivxl]+)\\b\\.?', ' ', 'g'), '[,;:\\s]+[0-9]+\\s*\\.?\\s*(cilt|band|tome|volume|cuz|kisim)\\b', ' ', 'g') AS w FROM raw),
bare AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(a, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\b({_TITLES_SQL})\\b', ' ', 'g'), ' +', ' ', 'g')) AS a, trim(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM turned),
named AS (SELECT doc_id, {_named_sql("a")} AS a, {_named_sql("w")} AS w FROM bare),
links AS (SELECT DISTINCT doc_id, 'a:' || string_split(a, ' ')[-1] || CASE WHEN len(string_split(a, ' ')) > 1 THEN ' ' || substr(a, 1, 1) ELSE '' END AS entity, a AS name FROM named WHERE a IS NOT NULL
  UNION SELECT DISTINCT doc_id, 'w:' || w, w FROM named WHERE w IS NOT NULL)"""

P2_FOUND_SQL = f"""
WITH {LINKS_SQL}, now AS (SELECT DISTINCT doc_id, split FROM documents JOIN pages USING (document_id) WHERE split IS NOT NULL)
SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM links x JOIN links y USING (entity) JOIN now p ON p.doc_id = x.doc_id JOIN now q ON q.doc_id = y.doc_id
WHERE x.doc_id < y.doc_id AND p.split <> q.split AND (starts_with(entity, 'w:') OR string_split(x.name, ' ')[1] = string_split(y.name, ' ')[1] OR least(length(string_split(x.name, ' ')[1]), length(string_split(y.name, ' ')[1])) <= 1)"""

P2_SPLITS_SQL = f"""
WITH RECURSIVE {LINKS_SQL},
tied AS (SELECT doc_id, entity FROM links WHERE starts_with(entity, 'w:')
  UNION SELECT doc_id, entity || ' ' || string_split(name, ' ')[1] FROM links WHERE starts_with(entity, 'a:') AND length(string_split(name, ' ')[1]) > 1
  UNION SELECT doc_id, entity FROM links WHERE starts_with(entity, 'a:') AND entity IN (SELECT entity FROM links WHERE starts_with(entity, 'a:') AND length(string_split(name, ' ')[1]) <= 1)),
heads AS (SELECT entity, min(doc_id) AS head FROM tied GROUP BY entity),
edges AS (SELECT DISTINCT doc_id AS a, head AS b FROM tied JOIN heads USING (entity) UNION SELECT DISTINCT head, doc_id FROM tied JOIN heads USING (entity)),
reach AS (SELECT doc_id AS node, doc_id AS m FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.m FROM reach r JOIN edges e ON e.a = r.node),
found AS (SELECT node AS doc_id, min(m) AS component FROM reach GROUP BY node),
placed AS (SELECT *, ('0x' || substr(sha256(component::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS place FROM found)
SELECT doc_id, component, CASE WHEN place < 0.9 THEN 'train' WHEN place < 0.95 THEN 'validation' ELSE 'test' END AS split FROM placed"""

P2_SHARES_SQL = f"""
WITH s AS ({P2_SPLITS_SQL}), c AS (SELECT split, component, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT split, sum(n)::BIGINT AS documents, count(*) AS components, max(n) AS largest_component FROM c GROUP BY split)
SELECT *, round(documents / (sum(documents) OVER ())::DOUBLE, 6) AS share, CASE split WHEN 'train' THEN 0.9 ELSE 0.05 END::DOUBLE AS target_share FROM t"""
