"""Queries over dictionaries, affixes and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qatlam.functions import text as T
from qatlam.operators import analysis as A
from qatlam.operators import lookup as L
from qatlam.plans import fragments as S
from qatlam.session import shared_folder, write_text
from qatlam.sources import lexicon
from qatlam.sources.tables import table


def stems(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.dictionary(table(spark, d, "stems"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """The distinct word tokens in dictionary spelling."""
    return table(spark, d, "tokens").where("token_type = 'word' and text is not null").select(T.fold_spelling("text").alias("word")).distinct()


def _variants(spark: SparkSession) -> DataFrame:
    return lexicon.affix_variants(lexicon.affixes(spark))


def affix_table(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.affixes(spark).select("affix_id", "base", "meaning_uz", "meaning_en", "affix_type", "category", F.array_join("variants", " ").alias("variants"), F.array_join("follows", " ").alias("follows"), "priority")


def affix_variants(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark).select("affix_id", "variant", "category", "priority", "lin_ord", "trie_ord")


def affix_usage(spark: SparkSession, d: str) -> DataFrame:
    """The data's own affix table by variant, with how often each text stands for it in the analyses."""
    own = table(spark, d, "affix").select("affix_id", F.explode("variants").alias("text"))
    used = table(spark, d, "morph_tokens").select("analysis_id", "suffix_pos", "text", "affix_id").distinct().groupBy("affix_id", "text").agg(F.count(F.lit(1)).alias("n"))
    return own.join(used, ["affix_id", "text"], "left").select("affix_id", "text", F.coalesce("n", F.lit(0)).alias("n"))


def suffix_matches(spark: SparkSession, d: str) -> DataFrame:
    found = L.find_suffixes(words(spark, d), _variants(spark).withColumnRenamed("variant", "suffix"), 7)
    return L.payload_order(found).select("word", "suffix", "affix_id", "rank")


def suffix_matches_linear(spark: SparkSession, d: str) -> DataFrame:
    """The same in the order of a linear scan: how many for each word, and the first."""
    found = L.find_suffixes(words(spark, d), _variants(spark).withColumnRenamed("variant", "suffix"), 7)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min_by("affix_id", "lin_ord").alias("first_affix"))


def suffix_completions(spark: SparkSession, d: str) -> DataFrame:
    """Word tokens among all affix variants: what ends each, and what completes it to a variant."""
    keys = _variants(spark).select(F.col("variant").alias("key")).distinct()
    return L.suffixes_and_completions(words(spark, d), keys, 7)


def prefix_matches(spark: SparkSession, d: str) -> DataFrame:
    return L.find_prefixes(words(spark, d), stems(spark, d)).select("word", "stem")


def prefix_longest(spark: SparkSession, d: str) -> DataFrame:
    return L.longest_prefix(words(spark, d), stems(spark, d))


def prefix_limit(spark: SparkSession, d: str) -> DataFrame:
    return L.words_with_prefix(stems(spark, d), "sh", 100)


def dict_iterate(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary in the order of its reversed strings."""
    return L.iterate_suffixes(stems(spark, d).select(F.col("stem").alias("suffix"))).select("suffix", F.reverse("suffix").alias("key"))


def dict_semi(spark: SparkSession, d: str) -> DataFrame:
    return L.known_words(words(spark, d), stems(spark, d))


def dict_anti(spark: SparkSession, d: str) -> DataFrame:
    return L.unknown_words(words(spark, d), stems(spark, d))


def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Membership of every word token, repeats included, as counts."""
    tokens = table(spark, d, "tokens").where("token_type = 'word' and text is not null").select(T.fold_spelling("text").alias("word"))
    return L.membership(tokens, stems(spark, d)).groupBy("word", "found").agg(F.count(F.lit(1)).alias("n"))


def payload_lookup(spark: SparkSession, d: str) -> DataFrame:
    """An index of the suffixes in use with their affix ids for payload, probed with all suffixes and all words."""
    used = table(spark, d, "morph_tokens").where("text is not null and affix_id is not null").select(F.col("text").alias("key"), F.col("affix_id").alias("payload")).distinct()
    index = L.insert_keys(spark.createDataFrame([], "key string, payloads array<string>"), used)
    probes = table(spark, d, "morph_tokens").where("text is not null").select(F.col("text").alias("key")).unionAll(words(spark, d)).distinct()
    return L.get_payloads(probes, index).select("key", F.array_join("payloads", " ").alias("payloads"))


def new_file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stem_file(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary, written to a file of stems and read again."""
    path = new_file(spark, "dictionary") + ".txt"
    lexicon.write_stems(stems(spark, d), path)
    return lexicon.read_stems(spark, path)


def hunspell_file(spark: SparkSession, d: str) -> DataFrame:
    """The stems of a Hunspell file made of the dictionary, by way of the file of stems that is kept beside it."""
    path = new_file(spark, "hunspell")
    listed = [r["stem"] for r in stems(spark, d).collect()]  # a dictionary
    write_text(path + ".dic", [f"{len(listed)}\n", *(f"{s}/{'AB'[k % 2]}\n" if k % 3 else f"{s}\n" for k, s in enumerate(listed))])
    lexicon.read_hunspell(spark, path + ".dic", path + ".txt")
    return lexicon.read_hunspell(spark, path + ".none", path + ".txt")


def dict_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.dictionary_stats(stems(spark, d))


def _suffix_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "morph_tokens").where("text is not null").select("text")


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary with the suffixes in use added and those that end in a vowel taken out again."""
    more = _suffix_texts(spark, d)
    return lexicon.remove_stems(lexicon.add_stems(stems(spark, d), more), more.where("text rlike '[aeiou]$'"))


def set_new(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.new_stems(stems(spark, d), _suffix_texts(spark, d))


def hunspell_parse(spark: SparkSession, d: str) -> DataFrame:
    """The stems written as lines of a Hunspell file, a count first, and read from them again."""
    known = stems(spark, d)
    lines = known.select(F.concat("stem", F.when(F.length("stem") % 2 == 0, "/AB").otherwise("")).alias("line")).unionAll(known.agg(F.count("stem").cast("string").alias("line")))
    return lexicon.parse_hunspell(lines)


def allomorph_check(spark: SparkSession, d: str) -> DataFrame:
    pairs = L.find_suffixes(words(spark, d), _variants(spark).select(F.col("variant").alias("suffix")).distinct(), 7)
    cut = pairs.select("word", "suffix", F.expr("left(word, length(word) - length(suffix))").alias("stem"))
    return cut.select("word", "suffix", A.check_allomorphs(F.col("stem"), F.col("suffix")).alias("fits"))


QUERIES = {
    q.__name__: q
    for q in (
        affix_table, affix_variants, affix_usage, suffix_matches, suffix_matches_linear, suffix_completions, prefix_matches, prefix_longest, prefix_limit, dict_iterate, dict_semi, dict_anti, batch_lookup, payload_lookup,
        dict_stats, set_ops, set_new, hunspell_parse, stem_file, hunspell_file, allomorph_check,
    )
}

_V, _W, _ST = S.variants(), S.WORDS, S.STEMS
_AFFIX_ROWS = [(i, b, uz, en, t, c, v, f, p) for i, b, uz, en, t, c, v, f, p in lexicon.AFFIXES]
_FOLDED = S.folded("text")
_MORE = f"more AS (SELECT DISTINCT text AS raw, {_FOLDED} AS stem FROM morph_tokens WHERE text IS NOT NULL AND {_FOLDED} <> '')"

SQL = {
    "affix_table": f"WITH {S.values('a', 'affix_id, base, meaning_uz, meaning_en, affix_type, category, variants, f, priority', _AFFIX_ROWS)} SELECT * EXCLUDE (f), nullif(f, '') AS follows FROM a",
    "affix_variants": f"WITH {_V} SELECT affix_id, variant, category, priority::INTEGER AS priority, lin_ord::INTEGER AS lin_ord, trie_ord::INTEGER AS trie_ord FROM variants",
    "affix_usage": """WITH own AS (SELECT affix_id, unnest(variants) AS text FROM affix), used AS (SELECT affix_id, text, count(*) AS n FROM
        (SELECT DISTINCT analysis_id, suffix_pos, text, affix_id FROM morph_tokens) GROUP BY ALL)
        SELECT own.affix_id, own.text, coalesce(n, 0) AS n FROM own LEFT JOIN used ON own.affix_id = used.affix_id AND own.text = used.text""",
    "suffix_matches": f"""WITH {_V}, {_W} SELECT word, variant AS suffix, affix_id, (row_number() OVER (PARTITION BY word ORDER BY trie_ord))::INTEGER AS rank FROM words JOIN variants ON suffix(word, variant)""",
    "suffix_matches_linear": f"WITH {_V}, {_W} SELECT word, count(*) AS n, min_by(affix_id, lin_ord) AS first_affix FROM words JOIN variants ON suffix(word, variant) GROUP BY word",
    "suffix_completions": f"""WITH {_V}, {_W}, k AS (SELECT DISTINCT variant AS word FROM variants),
        c AS (SELECT a.word, b.word[length(a.word) + 1:] AS match FROM words a JOIN k b ON starts_with(b.word, a.word) AND a.word <> b.word WHERE a.word <> ''),
        s AS (SELECT a.word, b.word AS match FROM words a JOIN k b ON suffix(a.word, b.word) WHERE a.word <> b.word OR a.word NOT IN (SELECT word FROM c))
        SELECT word, match, 'suffix' AS kind FROM s UNION SELECT word, match, 'completion' FROM c WHERE (word, match) NOT IN (SELECT (word, match) FROM s)""",
    "prefix_matches": f"WITH {_ST}, {_W} SELECT word, stem FROM words JOIN stem_list ON starts_with(word, stem) WHERE word <> ''",
    "prefix_longest": f"WITH {_ST}, {_W} SELECT word, max_by(stem, length(stem)) AS stem FROM words LEFT JOIN stem_list ON starts_with(word, stem) GROUP BY word",
    "prefix_limit": f"WITH {_ST} SELECT stem FROM stem_list WHERE starts_with(stem, 'sh') ORDER BY stem LIMIT 100",
    "dict_iterate": f"WITH {_ST} SELECT stem AS suffix, reverse(stem) AS key FROM stem_list",
    "stem_file": f"WITH {_ST} SELECT stem FROM stem_list",
    "hunspell_file": f"WITH {_ST} SELECT stem FROM stem_list",
    "dict_semi": f"WITH {_ST}, {_W} SELECT word FROM words WHERE word IN (SELECT stem FROM stem_list)",
    "dict_anti": f"WITH {_ST}, {_W} SELECT word FROM words WHERE word NOT IN (SELECT stem FROM stem_list)",
    "batch_lookup": f"""WITH {_ST}, t AS (SELECT {S.folded('text')} AS word FROM tokens WHERE token_type = 'word' AND text IS NOT NULL)
        SELECT word, word IN (SELECT stem FROM stem_list) AS found, count(*) AS n FROM t GROUP BY ALL""",
    "payload_lookup": f"""WITH {_W}, i AS (SELECT key, string_agg(affix_id, ' ' ORDER BY affix_id) AS payloads FROM (
          SELECT DISTINCT text AS key, affix_id FROM morph_tokens WHERE text IS NOT NULL AND affix_id IS NOT NULL) GROUP BY key),
        p AS (SELECT text AS key FROM morph_tokens WHERE text IS NOT NULL UNION SELECT word FROM words) SELECT p.key, payloads FROM p LEFT JOIN i ON p.key = i.key""",
    "dict_stats": f"""WITH {_ST} SELECT count(*) AS total_stems, avg(length(stem)) AS avg_length, min(length(stem))::INTEGER AS min_length, max(length(stem))::INTEGER AS max_length,
        count(*) FILTER (contains(stem, '''')) AS with_apostrophe FROM stem_list""",
    "set_ops": f"""WITH {_ST}, {_MORE} SELECT stem FROM (SELECT stem FROM stem_list UNION SELECT stem FROM more)
        WHERE stem NOT IN (SELECT stem FROM more WHERE regexp_matches(raw, '[aeiou]$'))""",
    "set_new": f"WITH {_ST}, {_MORE} SELECT DISTINCT stem FROM more WHERE stem NOT IN (SELECT stem FROM stem_list)",
    "hunspell_parse": f"WITH {_ST} SELECT stem FROM stem_list",
    "allomorph_check": f"""WITH {_V}, {_W}, p AS (SELECT DISTINCT word, variant AS suffix, left(word, length(word) - length(variant)) AS stem FROM words JOIN variants ON suffix(word, variant))
        SELECT word, suffix, CASE WHEN suffix IN ('qa','qan','qach','ka','kan','kach') THEN right(stem, 1) IN ('k','q')
          WHEN suffix IN ('ga','gan','gach') THEN right(stem, 1) NOT IN ('k','q') ELSE TRUE END AS fits FROM p""",
}
