"""Queries over text normalisation, predicates and splitting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qatlam.functions import text as T
from qatlam.functions.udfs import nfkc, unescape_html
from qatlam.operators import tokens as K
from qatlam.plans import fragments as S
from qatlam.sources.tables import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The distinct texts of tokens and analyses."""
    both = table(spark, d, "tokens").select("text").unionAll(table(spark, d, "analyses").select(F.col("original").alias("text")))
    return both.where("text is not null").distinct()


def apostrophe_norm(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("text", T.normalize_apostrophes("text").alias("normalized"))


def apostrophe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Normalised text, the apostrophes that were there, and the text restored from both."""
    marked = _texts(spark, d).select("text", T.normalize_apostrophes("text").alias("normalized"), T.apostrophe_offsets("text").alias("o"))
    return marked.select("text", F.size("o").alias("apostrophes"), F.array_join(F.transform("o", lambda x: F.concat(x["offset"].cast("string"), F.lit(":"), x["ch"])), " ").alias("offsets"), T.restore_apostrophes("normalized", "o").alias("restored"))


def normalize_core(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("text", T.fold_spelling("text").alias("normalized"))


def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary spelling with compatibility normalisation before it."""
    return nfkc(_texts(spark, d).withColumn("form", F.col("text")), "form").select("text", T.fold_spelling("form").alias("normalized"))


def translit(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("text", T.cyrillic_to_latin("text").alias("latin"))


def clean_text_core(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", T.clean_text("text").alias("cleaned"))


def html_unescape_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a web page has them, with entities by name, by number and by hexadecimal number, resolved and cleaned."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    page = F.col("text")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("«", "&laquo;"), ("—", "&#8212;"), ("ʻ", "&#x2BB;"), ("ʼ", "&#700;")):
        page = F.replace(page, F.lit(plain), F.lit(entity))
    return unescape_html(docs.withColumn("text", page), "text").select("doc_id", T.clean_text("text").alias("cleaned"))


def script_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.detect_script("text").alias("detected"), T.has_cyrillic("text").alias("has_cyrillic"))


def uzbek_word_filter(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("text", T.is_uzbek_word("text").alias("strict"), T.is_uzbek_word("text", strict=False).alias("lax"))


def case_restored(spark: SparkSession, d: str) -> DataFrame:
    """Each word token's root in the case of the token."""
    roots = table(spark, d, "analyses").where("original is not null and root is not null").select("original", "root").distinct()
    return roots.select("original", "root", T.restore_case("root", "original").alias("restored"))


def tok_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Raw tokens of each document by type, text as it is."""
    cut = K.split_text(table(spark, d, "documents"), clean=False)
    return cut.groupBy("doc_id", "token_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def tok_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Word tokens of each document alone, cleaned text, with their first and last position."""
    words = K.keep_tokens(K.split_text(table(spark, d, "documents")), include_punct=False)
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


QUERIES = {
    q.__name__: q
    for q in (
        apostrophe_norm, apostrophe_roundtrip, normalize_core, nfkc_normalize, translit, clean_text_core, html_unescape_clean, script_detect, uzbek_word_filter, case_restored, tok_split_counts, tok_filtered,
    )
}

_TEXTS = "texts AS (SELECT text FROM tokens WHERE text IS NOT NULL UNION SELECT original FROM analyses WHERE original IS NOT NULL)"
_AP = S.quoted(S.C.APOSTROPHES)
_CYR, _LAT = "regexp_matches(text, '[\\x{0400}-\\x{052f}]')", "regexp_matches(text, '[a-zA-Z]')"
_UZ = """regexp_matches(text, '^[a-zA-Z][a-zA-Z''ʻʼ’‘]*$') AND NOT contains(text, chr(10)) AND NOT regexp_matches(text, '(^|[^oOgG])[''ʻʼ’‘]$')
  AND NOT regexp_matches(text, '[''ʻʼ’‘]{2}')"""

# NFKC is the canonical composition of the compatibility decompositions, which are a rule of the character database
_COMPATIBLE = [(c, k) for c in map(chr, range(0xA0, 0x110000)) if (k := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c)]
_NFKC = f"""compatible(ch, decomposed) AS (VALUES {", ".join(f"(chr({ord(c)}), {S.quoted(k)})" for c, k in _COMPATIBLE)}),
    places AS (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM texts), chars AS (SELECT text, i, text[i] AS cluster FROM places),
    points AS (SELECT text, i, unnest(range(1, len(u) + 1)) AS j, u FROM (SELECT text, i, list_filter(regexp_split_to_array(cluster, ''), lambda x: x <> '') AS u FROM chars)),
    resolved AS (SELECT p.text, string_agg(coalesce(m.decomposed, p.u[p.j]), '' ORDER BY i, j) AS spelled FROM points p LEFT JOIN compatible m ON m.ch = p.u[p.j] GROUP BY p.text),
    forms AS (SELECT t.text, nfc_normalize(coalesce(r.spelled, t.text)) AS form FROM texts t LEFT JOIN resolved r ON t.text = r.text)"""

SQL = {
    "html_unescape_clean": f"SELECT doc_id, {S.cleaned('text')} AS cleaned FROM documents WHERE text IS NOT NULL",
    "nfkc_normalize": f"WITH {_TEXTS}, {_NFKC} SELECT text, {S.folded('form')} AS normalized FROM forms",
    "apostrophe_norm": f"WITH {_TEXTS} SELECT text, {S.apostrophes('text')} AS normalized FROM texts",
    "apostrophe_roundtrip": f"""WITH {_TEXTS}, o AS (
        SELECT text, list_filter(list_transform(range(0, length(text)), lambda i: CASE WHEN contains({_AP}, text[i + 1]) THEN i::VARCHAR || ':' || text[i + 1] END), lambda x: x IS NOT NULL) AS found FROM texts)
        SELECT text, len(found)::INTEGER AS apostrophes, array_to_string(found, ' ') AS offsets, text AS restored FROM o""",
    "normalize_core": f"WITH {_TEXTS} SELECT text, {S.folded('text')} AS normalized FROM texts",
    "translit": f"WITH {_TEXTS} SELECT text, {S.transliterated('text')} AS latin FROM texts",
    "clean_text_core": f"SELECT doc_id, {S.cleaned('text')} AS cleaned FROM documents WHERE text IS NOT NULL",
    "script_detect": f"""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN {_CYR} AND {_LAT} THEN 'mixed' WHEN {_CYR} THEN 'cyrillic'
        WHEN {_LAT} THEN 'latin' ELSE 'other' END AS detected, coalesce({_CYR}, FALSE) AS has_cyrillic FROM documents""",
    "uzbek_word_filter": f"WITH {_TEXTS} SELECT text, {_UZ} AND NOT regexp_matches(text, '[wW]|[cC]([^hH]|$)') AS strict, {_UZ} AS lax FROM texts",
    "case_restored": f"SELECT DISTINCT original, root, {S.cased_like('root', 'original')} AS restored FROM analyses WHERE original IS NOT NULL AND root IS NOT NULL",
    "tok_split_counts": f"""SELECT doc_id, {S.token_type('t')} AS token_type, count(*) AS n, sum(length(t))::BIGINT AS chars
        FROM (SELECT doc_id, unnest({S.raw_tokens(S.apostrophes('text'))}) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL""",
    "tok_filtered": f"""SELECT doc_id, count(*) AS words, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos FROM (
        SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT doc_id, {S.raw_tokens(S.apostrophes(S.cleaned('text')))} AS ts FROM documents WHERE text IS NOT NULL))
        WHERE {S.token_type('t')} = 'word' GROUP BY doc_id""",
}
