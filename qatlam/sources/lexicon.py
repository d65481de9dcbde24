"""Affixes, sound changes and stem dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qatlam.functions.text import fold_spelling
from qatlam.functions.udfs import nfkc
from qatlam.session import file_exists, write_text

# The affixes. Columns: id, base, meaning in Uzbek, meaning in English, type,
# category, variants, categories it may follow ("" = any), priority.
_NOUN = "plural word_formation diminutive"
_CASE = "plural possession word_formation"
_VERB = "tense participle word_formation"
AFFIXES = [
    ("pl_lar", "lar", "ko'plik", "plural", "inflectional", "plural", "lar", "word_formation diminutive", 10),
    ("poss_1sg", "m", "1-shaxs birlik egalik", "1st person singular possession", "inflectional", "possession", "m im", _NOUN, 0),
    ("poss_2sg", "ng", "2-shaxs birlik egalik", "2nd person singular possession", "inflectional", "possession", "ng ing", _NOUN, 0),
    ("poss_3sg", "si", "3-shaxs birlik egalik", "3rd person singular possession", "inflectional", "possession", "i si", _NOUN, 0),
    ("poss_1pl", "miz", "1-shaxs ko'plik egalik", "1st person plural possession", "inflectional", "possession", "miz imiz", _NOUN, 0),
    ("poss_2pl", "ngiz", "2-shaxs ko'plik egalik", "2nd person plural possession", "inflectional", "possession", "ngiz ingiz", _NOUN, 0),
    ("poss_3pl", "lari", "3-shaxs ko'plik egalik", "3rd person plural possession", "inflectional", "possession", "lari", "word_formation diminutive", 0),
    ("case_gen", "ning", "qaratqich", "genitive", "inflectional", "case", "ning", _CASE, 5),
    ("case_acc", "ni", "tushum", "accusative", "inflectional", "case", "ni", _CASE, 5),
    ("case_dat", "ga", "jo'nalish", "dative", "inflectional", "case", "ga ka qa", _CASE, 5),
    ("case_loc", "da", "o'rin-payt", "locative", "inflectional", "case", "da ta", _CASE, 5),
    ("case_abl", "dan", "chiqish", "ablative", "inflectional", "case", "dan tan", _CASE, 5),
    ("tense_past", "di", "o'tgan zamon", "past tense", "inflectional", "tense", "di ti", "", 0),
    ("tense_pres_yapti", "yapti", "hozirgi zamon", "present tense", "inflectional", "tense", "yapti yotir moqda yap", "", 0),
    ("tense_fut_a", "a", "kelasi zamon", "future tense", "inflectional", "tense", "a y", "", 0),
    ("tense_pres_ydi", "ydi", "hozirgi-kelasi zamon", "present-future tense", "inflectional", "tense", "ydi di", "", 0),
    ("partic_gan", "gan", "sifatdosh (o'tgan)", "participle (past)", "inflectional", "participle", "gan kan qan", "", 0),
    ("partic_digan", "digan", "sifatdosh (hozirgi/kelasi)", "participle (present/future)", "inflectional", "participle", "adigan ydigan digan", "", 0),
    ("partic_ar", "ar", "sifatdosh", "participle", "inflectional", "participle", "ar r", "", 0),
    ("partic_mas", "mas", "sifatdosh (inkor)", "participle (negative)", "inflectional", "participle", "mas", "", 0),
    ("gerund_ib", "ib", "ravishdosh", "gerund", "inflectional", "gerund", "ib b", "", 0),
    ("gerund_gach", "gach", "ravishdosh", "gerund", "inflectional", "gerund", "gach kach qach", "", 0),
    ("gerund_guncha", "guncha", "ravishdosh", "gerund", "inflectional", "gerund", "guncha kuncha quncha", "", 0),
    ("neg_ma", "ma", "inkor", "negation", "inflectional", "negation", "ma mas may", "", 0),
    ("verb_pers_1sg", "man", "1-shaxs birlik", "1st person singular", "inflectional", "person", "man", _VERB, 0),
    ("verb_pers_2sg", "san", "2-shaxs birlik", "2nd person singular", "inflectional", "person", "san", _VERB, 0),
    ("verb_pers_1pl", "miz", "1-shaxs ko'plik", "1st person plural", "inflectional", "person", "miz", _VERB, 0),
    ("verb_pers_2pl", "siz", "2-shaxs ko'plik", "2nd person plural", "inflectional", "person", "siz sizlar", _VERB, 0),
    ("verb_pers_3pl", "dilar", "3-shaxs ko'plik", "3rd person plural", "inflectional", "person", "lar dilar", _VERB, 0),
    ("deriv_chi", "chi", "shaxs oti yasovchi", "noun to noun", "derivational", "word_formation", "chi", "", 0),
    ("deriv_lik", "lik", "mavhum ot yasovchi", "noun to noun", "derivational", "word_formation", "lik lig", "", 0),
    ("deriv_li", "li", "sifat yasovchi", "noun to adj", "derivational", "word_formation", "li", "", 0),
    ("deriv_siz", "siz", "sifat yasovchi", "noun to adj", "derivational", "word_formation", "siz", "", 0),
    ("deriv_la", "la", "fe'l yasovchi", "noun/adj to verb", "derivational", "word_formation", "la lan lash lashtir", "", 0),
    ("deriv_ish", "ish", "harakat nomi", "verb to noun", "derivational", "word_formation", "ish sh", "", 0),
    ("part_ku", "ku", "yuklama", "particle", "particle", "particle_cat", "ku", "", 0),
    ("part_chi", "chi", "yuklama", "particle", "particle", "question", "chi", "", 0),
    ("part_da", "da", "yuklama", "particle", "particle", "particle_cat", "da", "", 0),
    ("part_mi", "mi", "so'roq yuklama", "question particle", "particle", "question", "mi", "", 0),
]
# Surface stems with a dropped vowel or a softened consonant, and the dictionary's form.
SOUND_CHANGES = {
    "shahr": "shahar", "singl": "singil", "burn": "burun", "oʻgʻl": "oʻgʻil", "bagʻr": "bagʻir", "koʻngl": "koʻngil", "qorn": "qorin",
    "boʻyn": "boʻyin", "ogʻz": "ogʻiz", "qovrgʻ": "qovurgʻa", "yurag": "yurak", "qishlogʻ": "qishloq", "barmogʻ": "barmoq", "qulogʻ": "quloq",
    "tarmogʻ": "tarmoq", "yoprogʻ": "yaproq", "tayogʻ": "tayoq", "oʿrtogʻ": "oʿrtoq", "oʻrtogʻ": "oʻrtoq", "tirnogʻ": "tirnoq",
}

AFFIX_SCHEMA = "affix_id string, base string, meaning_uz string, meaning_en string, affix_type string, category string, variants array<string>, follows array<string>, priority int"


def affixes(spark: SparkSession) -> DataFrame:
    """The affix table, one row each; null ``follows`` means any place."""
    rows = [(i, b, uz, en, t, c, v.split(), f.split() or None, p) for i, b, uz, en, t, c, v, f, p in AFFIXES]
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], AFFIX_SCHEMA + ", ord int")


def affix_variants(table: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each variant of each affix, with the two orders in which they are tried.

    ``lin_ord`` goes by length, then priority, longest and highest first, and keeps the table's
    order among equals; ``trie_ord`` goes by length and turns equals round.
    """
    each = table.select("*", F.posexplode("variants").alias("variant_pos", "variant"))
    by_list = Window.orderBy(F.desc(F.length("variant")), F.desc("priority"), order, "variant_pos")
    listed = each.withColumn("lin_ord", F.row_number().over(by_list))
    by_trie = Window.orderBy(F.desc(F.length("variant")), F.desc("lin_ord"))
    return listed.withColumn("trie_ord", F.row_number().over(by_trie)).drop("variants", "variant_pos")


def affix_by_id(table: DataFrame, affix_id: str) -> DataFrame:
    return table.where(F.col("affix_id") == affix_id)


def sound_changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOUND_CHANGES.items()), "surface string, canonical string")


# ------------------------------------------------------------------ dictionaries
def dictionary(*sources: DataFrame) -> DataFrame:
    """The distinct stems of the sources' first columns in dictionary spelling. Null and empty stems are left out.

    The library brings no stems of its own: a dictionary is a parameter wherever one is needed.
    """
    stems = [s.select(F.col(s.columns[0]).cast("string").alias("stem")) for s in sources]
    united = stems[0]
    for s in stems[1:]:
        united = united.unionAll(s)
    return nfkc(united, "stem").select(fold_spelling("stem").alias("stem")).where("stem != ''").distinct()


def add_stems(known: DataFrame, more: DataFrame) -> DataFrame:
    return known.select("stem").unionAll(dictionary(more)).distinct()


def remove_stems(known: DataFrame, unwanted: DataFrame) -> DataFrame:
    return known.join(dictionary(unwanted), "stem", "left_anti")


def new_stems(known: DataFrame, more: DataFrame) -> DataFrame:
    """The stems of ``more`` that ``known`` lacks; their count is what loading them adds."""
    return dictionary(more).join(known, "stem", "left_anti")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    if not file_exists(path):
        raise FileNotFoundError(f"no dictionary file at {path}")
    return spark.read.text(path).select(F.trim("value").alias("line"))


def read_stems(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary of one stem a line; blank lines and lines that begin with # are skipped."""
    return dictionary(_lines(spark, path).where("line != '' and not startswith(line, '#')"))


def parse_hunspell(lines: DataFrame) -> DataFrame:
    """The stems of the lines (column ``line``) of a Hunspell dictionary: flags cut off, the count left out."""
    return dictionary(lines.where("not line rlike '^[0-9]+$'").select(F.trim(F.substring_index("line", "/", 1)).alias("stem")))


def read_hunspell(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """The stems of a Hunspell dictionary file, or of ``cache``, a file written before, if that exists.

    The file must be at hand: nothing is downloaded. With ``cache``, the stems are written there.
    """
    if cache and file_exists(cache):
        return read_stems(spark, cache)
    if not file_exists(path):
        raise ConnectionError(f"no dictionary at {path}")
    stems = parse_hunspell(_lines(spark, path))
    if cache:
        write_stems(stems, cache)
    return stems


def write_stems(stems: DataFrame, path: str) -> None:
    """One stem a line, sorted, in one file of this name (a dictionary is small)."""
    write_text(path, (row["stem"] + "\n" for row in stems.orderBy("stem").toLocalIterator()))


def dictionary_stats(stems: DataFrame) -> DataFrame:
    """One row: total_stems, avg_length, min_length, max_length, with_apostrophe; zeros for an empty dictionary."""
    n = F.length("stem")
    return stems.agg(
        F.count("stem").alias("total_stems"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"), F.coalesce(F.min(n), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_length"), F.count_if(F.col("stem").contains("'")).alias("with_apostrophe"),
    )
