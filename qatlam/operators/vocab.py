"""The unified vocabulary of the hybrid tokenizer, ids and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qatlam.operators.bpe import Model
from qatlam.operators.lookup import _side
from qatlam.sources import lexicon

# The special tokens, and the marks and digits, in order of their ids.
SPECIALS = ["<pad>", "<unk>", "<s>", "</s>", "<mask>"]
MARKS = ".,!?:;-\"'/\\()[]{}0123456789"
UNK = 1


def build_vocab(spark: SparkSession, stems: DataFrame, affix_table: DataFrame | None = None, model: Model | None = None, by: str = "ord") -> DataFrame:
    """(token, id), ids from 0 without gaps: specials, marks, affixes, stems, byte-pair tokens; the first occurrence counts.

    A vocabulary is of a dictionary's size, so its one window isn't split.
    """
    fixed = [(0, i, t) for i, t in enumerate(SPECIALS)] + [(1, i, c) for i, c in enumerate(MARKS)]
    parts = spark.createDataFrame(fixed, "section int, at int, token string")
    variants = lexicon.affix_variants(affix_table if affix_table is not None else lexicon.affixes(spark), by)
    parts = parts.unionAll(variants.select(F.lit(2), "lin_ord", F.concat(F.lit("##"), "variant")))
    parts = parts.unionAll(stems.select(F.lit(3), F.lit(0), F.concat(F.lit("Ġ"), "stem")).distinct())
    if model is not None:
        parts = parts.unionAll(spark.createDataFrame([(4, 0, t) for t in model.vocab], "section int, at int, token string"))
    first = parts.groupBy("token").agg(F.min(F.struct("section", "at")).alias("place"))
    return first.select("token", (F.row_number().over(Window.orderBy("place", "token")) - 1).alias("id"))


def lookup_ids(subwords: DataFrame, vocab: DataFrame, subword: str = "subword") -> DataFrame:
    """``subwords`` with their ``id``: as it is, with the root in small letters, all in small letters, or unknown.

    The three forms are found for distinct subwords, so the vocabulary is probed once for each.
    """
    s = F.col(subword)
    options = F.array(
        F.struct(F.lit(0).alias("nth"), s.alias("token")),
        F.struct(F.lit(1).alias("nth"), F.when(s.startswith("Ġ"), F.concat(F.lit("Ġ"), F.lower(s.substr(F.lit(2), F.length(s))))).alias("token")),
        F.struct(F.lit(2).alias("nth"), F.lower(s).alias("token")),
    )
    distinct = subwords.select(subword).where(s.isNotNull()).distinct()
    forms = distinct.withColumn("x", F.explode(options)).select(subword, "x.nth", "x.token").where("token is not null")
    best = forms.join(_side(vocab.select("token", "id")), "token").groupBy(subword).agg(F.min_by("id", "nth").alias("id"))
    return subwords.drop("id").join(_side(best), subword, "left").withColumn("id", F.coalesce("id", F.lit(UNK)))


def encode(strings: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", column: str = "strings") -> DataFrame:
    """(doc_id, ids) of documents' subwords; a document without any has an empty list."""
    each = strings.select(doc_id, F.posexplode(column).alias("pos", "subword"))
    found = lookup_ids(each, vocab).groupBy(doc_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return strings.select(doc_id).join(found, doc_id, "left").select(doc_id, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): special and unknown tokens drop out; a root or other token takes a space before it unless it is first, an affix and a mark don't."""
    each = encoded.select(doc_id, F.posexplode(ids).alias("pos", "id")).join(_side(vocab.select("token", "id")), "id", "left")
    kept = each.where(F.col("token").isNotNull() & ~F.col("token").isin(*SPECIALS))
    t = F.col("token")
    root = t.startswith("Ġ")
    glued = t.startswith("##") | F.lit(".,!?:;").contains(t)
    bare = F.when(root, t.substr(F.lit(2), F.length(t))).when(t.startswith("##"), t.substr(F.lit(3), F.length(t))).otherwise(t)
    piece = F.concat(F.when(root | ~glued, F.lit(" ")).otherwise(F.lit("")), bare)
    joined = kept.select(doc_id, F.struct("pos", piece.alias("s"), (root | ~glued).alias("spaced"), bare.alias("bare")).alias("x"))
    out = joined.groupBy(doc_id).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # no space before the first token that isn't empty: the text so far decides
    text = F.aggregate("xs", F.lit(""), lambda acc, x: F.concat(acc, F.when(acc == "", x["bare"]).otherwise(x["s"])))
    return encoded.select(doc_id).join(out.select(doc_id, text.alias("text")), doc_id, "left").select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
