"""The hybrid tokenizer: raw tokens, their analysis or byte pairs, subwords, statistics.

Words are analysed once each and joined back. A word that is everywhere would make one task of that
join long: the analyses are broadcast where they are small enough, and else joined by fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qatlam.functions import text as T
from qatlam.functions.udfs import nfkc, unescape_html
from qatlam.operators import bpe as B
from qatlam.operators.analysis import MAX_DEPTH, Affixes, analyze
from qatlam.operators.balance import fragment_replicate_join
from qatlam.operators.lookup import BROADCAST_BYTES
from qatlam.session import materialise
from qatlam.sources.tables import small_enough, spread


def split_text(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", clean: bool = True) -> DataFrame:
    """(doc_id, pos, text, token_type) of every raw token, blanks included; positions count from 0.

    With ``clean``, entities are resolved and markup, addresses and ornaments taken out first. Null
    and empty texts have no tokens.
    """
    docs = spread(documents.where(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("__t")))
    if clean:
        docs = unescape_html(docs, "__t").withColumn("__t", T.clean_text("__t"))
    cut = docs.select(doc_id, F.posexplode(T.raw_tokens(T.normalize_apostrophes("__t"))).alias("pos", "text"))
    return cut.withColumn("token_type", T.token_type("text"))


def keep_tokens(tokens: DataFrame, include_spaces: bool = False, include_punct: bool = True) -> DataFrame:
    """The tokens wanted; positions keep counting all raw tokens."""
    wanted = F.col("token_type") == "word"
    if include_spaces:
        wanted = wanted | (F.col("token_type") == "whitespace")
    if include_punct:
        wanted = wanted | (F.col("token_type") == "punctuation")
    return tokens.where(wanted)


def dictionary_forms(tokens: DataFrame) -> DataFrame:
    """(text, word): each distinct word token and its dictionary spelling."""
    words = tokens.where("token_type = 'word'").select("text").distinct()
    return nfkc(words.withColumn("word", F.col("text")), "word").withColumn("word", T.fold_spelling("word"))


def analyse_words(tokens: DataFrame, stems: DataFrame, affixes: Affixes, max_depth: int = MAX_DEPTH, model: B.Model | None = None) -> DataFrame:
    """One row for each distinct word token: text, morph, subtokens, is_morph, is_bpe.

    A word with a known root is morphology. Else, with a byte-pair model, an unknown root is cut
    into pieces and keeps its suffixes, and a word without suffixes is cut whole; without a model,
    suffixes alone are kept, and a word without any stays bare.
    """
    forms = dictionary_forms(tokens)
    found = analyze(forms.select("word"), stems, affixes, max_depth)
    rows = forms.join(found, "word")
    suffixed = F.size("suffixes") > 0
    if model is None:
        pieces = F.lit(None).cast("array<string>")
    else:
        # the root of an analysis, or the word as it stands
        rows = rows.withColumn("__piece", F.when(suffixed, F.col("root")).otherwise(F.col("text")))
        rows = B.segment_column(rows, "__piece", model, "__pieces")
        pieces = F.when(~F.col("is_found"), F.col("__pieces"))
    use_bpe = F.lit(model is not None) & ~F.col("is_found")
    # a word cut whole has no analysis to show
    morph = F.struct(F.when(F.col("is_found") | suffixed, F.col("word")).otherwise(F.col("text")).alias("original"), "root", "suffixes", "is_found", "is_compound", "confidence")
    return rows.select(
        "text", F.when(~use_bpe | suffixed, morph).alias("morph"), pieces.alias("subtokens"),
        (F.col("is_found") | suffixed).alias("is_morph"), use_bpe.alias("is_bpe"),
    )


def tokenize(
    documents: DataFrame, stems: DataFrame, affixes: Affixes, doc_id: str = "doc_id", text: str = "text", clean: bool = True, include_spaces: bool = False, include_punct: bool = True,
    max_depth: int = MAX_DEPTH, model: B.Model | None = None,
) -> DataFrame:
    """(doc_id, pos, text, token_type, morph, subtokens, token_ids, is_morph, is_bpe) of every token."""
    tokens = keep_tokens(split_text(documents, doc_id, text, clean), include_spaces, include_punct)
    # written, so that words are analysed once and the size of the table is known when it is joined
    distinct = materialise(tokens.where("token_type = 'word'").select("text", "token_type").distinct(), "word-tokens")
    words = materialise(analyse_words(distinct, stems, affixes, max_depth, model), "word-analyses")
    return join_words(tokens, words, doc_id)


def join_words(tokens: DataFrame, words: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The tokens with what is known of their words; other tokens have none of it."""
    none = F.lit(None).cast("array<int>").alias("token_ids")
    is_word = F.col("token_type") == "word"
    keyed = tokens.withColumn("__w", F.when(is_word, F.col("text")))
    named = words.withColumnRenamed("text", "__w")
    if small_enough(words, BROADCAST_BYTES):
        joined = keyed.join(F.broadcast(named), "__w", "left")
    else:
        joined = fragment_replicate_join(keyed, named, "__w", F.struct(doc_id, "pos"), "left")
    return joined.select(doc_id, "pos", "text", "token_type", "morph", "subtokens", none, F.coalesce("is_morph", F.lit(False)).alias("is_morph"), F.coalesce("is_bpe", F.lit(False)).alias("is_bpe"))


def encode_documents(
    documents: DataFrame, stems: DataFrame, affixes: Affixes, vocab: DataFrame, style: str = "hybrid", doc_id: str = "doc_id", text: str = "text", clean: bool = True,
    max_depth: int = MAX_DEPTH, model: B.Model | None = None,
) -> DataFrame:
    """(doc_id, ids) of every document that has a token.

    Ids are found once for each distinct token, in a table of a vocabulary's size; the tokens
    themselves are joined with it and shuffled once, to their documents.
    """
    from qatlam.operators.vocab import lookup_ids

    tokens = keep_tokens(split_text(documents, doc_id, text, clean))
    distinct = materialise(tokens.select("text", "token_type").distinct(), "distinct-tokens")
    known = distinct.join(analyse_words(distinct, stems, affixes, max_depth, model), "text", "left")
    known = known.withColumn("is_morph", F.coalesce("is_morph", F.lit(False))).withColumn("is_bpe", F.coalesce("is_bpe", F.lit(False)))
    each = materialise(known.select("text", F.posexplode(subwords(style)).alias("nth", "subword")), "subwords")
    ids = lookup_ids(each, vocab).groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("ids"))
    ids = materialise(ids, "token-ids")
    if small_enough(ids, BROADCAST_BYTES):
        joined = tokens.select(doc_id, "pos", "text").join(F.broadcast(ids), "text")
    else:
        joined = fragment_replicate_join(tokens.select(doc_id, "pos", "text"), ids, "text", F.struct(doc_id, "pos"))
    return joined.groupBy(doc_id).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))


# ------------------------------------------------------------------ subwords
# What stands before a word and before its other pieces, by style.
STYLES = {"hybrid": ("Ġ", "##"), "bert": ("", "##"), "gpt": ("Ġ", ""), "sentencepiece": (" ", ""), "plus": ("", "+")}


def subwords(style: str = "hybrid") -> Column:
    """The subwords of a token row; any other style has no prefixes."""
    first, other = STYLES.get(style, ("", ""))
    tail = F.transform(F.coalesce(F.col("morph.suffixes"), F.from_json(F.lit("[]"), SUFFIXES)), lambda s: F.concat(F.lit(other), s["text"]))
    cut = F.concat(F.array(F.concat(F.lit(first), F.get("subtokens", F.lit(0)))), F.transform(F.slice("subtokens", 2, F.greatest(F.size("subtokens") - 1, F.lit(0))), lambda p: F.concat(F.lit(other), p)))
    pieces = F.coalesce(F.size("subtokens") > 0, F.lit(False)) & F.col("is_bpe")
    known = F.col("is_morph") & F.col("morph").isNotNull() & (F.col("morph.is_found") | (F.size("morph.suffixes") > 0))
    return (
        F.when(F.col("token_type") != "word", F.array("text"))
        .when(F.col("is_morph") & pieces, F.concat(cut, tail))
        .when(known, F.concat(F.array(F.concat(F.lit(first), T.restore_case(F.col("morph.root"), F.col("text")))), tail))
        .when(pieces, cut)
        .otherwise(F.array(F.concat(F.lit(first), F.col("text"))))
    )


SUFFIXES = "array<struct<text:string,affix_id:string,meaning_uz:string,meaning_en:string,affix_type:string,category:string>>"


def token_strings(tokens: DataFrame, style: str = "plus", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, strings): the subwords of each document in order; a document without tokens has no row.

    The words' subwords are made once a token and ordered within the document, whose text bounds them.
    """
    cut = tokens.select(doc_id, F.struct("pos", subwords(style).alias("s")).alias("x"))
    return cut.groupBy(doc_id).agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"])).alias("strings"))


def token_root(morph: Column) -> Column:
    """The root of an analysis, if it was found."""
    return F.when(morph["is_found"], morph["root"])


def token_record() -> Column:
    """A token row as JSON; what it hasn't is left out."""
    from qatlam.operators.analysis import suffix_chain

    m = F.col("morph")
    full = F.struct(
        m["original"].alias("original"), m["root"].alias("root"), F.when(m["is_found"], "found").otherwise("unknown").alias("status"), m["is_compound"].alias("is_compound"),
        F.round(m["confidence"], 3).alias("confidence"), m["suffixes"].alias("suffixes"), suffix_chain(m["suffixes"]).alias("suffix_chain"),
    )
    return F.to_json(F.struct("text", F.col("token_type").alias("type"), "is_morph", "is_bpe", F.when(m.isNotNull(), full).alias("morph"), F.when(F.size("subtokens") > 0, F.col("subtokens")).alias("subtokens")))


def token_stats(tokens: DataFrame, stems: DataFrame | None = None, bpe_trained: bool = False) -> DataFrame:
    """One row of counts over tokens made with marks included, and the share of words with a known root."""
    word = F.col("token_type") == "word"
    found = word & F.coalesce(F.col("morph.is_found"), F.lit(False))
    out = tokens.agg(
        F.count_if(word).alias("total_tokens"), F.count_if(found).alias("morph_found"), F.count_if(word & ~found).alias("morph_not_found"),
        F.count_if("is_bpe").alias("bpe_used"), F.count_if(F.col("token_type") == "punctuation").alias("punct_tokens"), F.lit(0).cast("long").alias("num_tokens"),
    )
    share = F.when(F.col("total_tokens") > 0, F.format_string("%.1f%%", F.col("morph_found") / F.col("total_tokens") * 100)).otherwise("N/A")
    out = out.withColumn("morph_accuracy", share).withColumn("bpe_trained", F.lit(bpe_trained))
    return out if stems is None else out.crossJoin(F.broadcast(stems.agg(F.count_distinct("stem").alias("dictionary_size"))))


def method_metrics(tokens: DataFrame, style: str = "hybrid") -> DataFrame:
    """One row: words, subwords in all and for each word, and the share of words with a known root."""
    words = tokens.where("token_type = 'word'").select(F.size(subwords(style)).alias("n"), F.coalesce(F.col("morph.is_found"), F.lit(False)).alias("found"))
    return words.agg(F.count("n").alias("words"), F.sum("n").alias("subwords"), F.avg("n").alias("per_word"), F.avg(F.col("found").cast("int")).alias("root_share"))


def quick_tokenize(documents: DataFrame, stems: DataFrame, affixes: Affixes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Strings in the plus style with a depth of ten, in one call."""
    return token_strings(tokenize(documents, stems, affixes, doc_id, text, max_depth=10), "plus", doc_id)
