"""Queries over the hybrid tokenizer and its vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qatlam.operators import analysis as A
from qatlam.operators import bpe as B
from qatlam.operators import tokens as K
from qatlam.operators import vocab as V
from qatlam.plans import fragments as S
from qatlam.plans.lexical import new_file, stems
from qatlam.session import materialise
from qatlam.sources import models
from qatlam.sources.tables import table


def _tokens(spark: SparkSession, d: str, model: B.Model | None = None, include_spaces: bool = False) -> DataFrame:
    return K.tokenize(table(spark, d, "documents"), stems(spark, d), A.default_affixes(spark), include_spaces=include_spaces, model=model)


def _word_rows(spark: SparkSession, d: str, model: B.Model | None = None) -> DataFrame:
    """The distinct raw tokens of the documents with what is known of them and how often they occur."""
    tokens = K.keep_tokens(K.split_text(table(spark, d, "documents")))
    counted = materialise(tokens.groupBy("text", "token_type").agg(F.count(F.lit(1)).alias("n")), "raw-tokens")
    words = K.analyse_words(counted, stems(spark, d), A.default_affixes(spark), model=model)
    kept = counted.join(words, "text", "left")
    return kept.withColumn("is_morph", F.coalesce("is_morph", F.lit(False))).withColumn("is_bpe", F.coalesce("is_bpe", F.lit(False)))


def subword_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each hybrid subword occurs in the documents: raw tokens are counted before words are analysed, so each is shuffled once."""
    return _word_rows(spark, d).select("n", F.explode(K.subwords("hybrid")).alias("subword")).groupBy("subword").agg(F.sum("n").alias("n"))


def subword_styles(spark: SparkSession, d: str) -> DataFrame:
    """The subwords of each distinct token in every style."""
    rows = _word_rows(spark, d)
    return rows.select("text", *(F.array_join(K.subwords(s), "|").alias(s) for s in K.STYLES))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.token_stats(_tokens(spark, d), stems(spark, d))


def method_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Subwords for each word and the share of known roots, over all words of the documents."""
    words = K.method_metrics(_tokens(spark, d))
    return words.select("words", "subwords", F.round("per_word", 6).alias("per_word"), F.round("root_share", 6).alias("root_share"))


def token_records(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct token as a nested record in JSON."""
    return _word_rows(spark, d).select("text", K.token_record().alias("record"))


def doc_subwords(spark: SparkSession, d: str) -> DataFrame:
    """The plus-style strings of every document, joined."""
    return K.token_strings(_tokens(spark, d), "plus").select("doc_id", F.size("strings").alias("n"), F.array_join("strings", " ").alias("strings"))


def unified_vocab(spark: SparkSession, d: str) -> DataFrame:
    return V.build_vocab(spark, stems(spark, d))


def vocab_file(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary, written to a file and read again."""
    path = new_file(spark, "vocab") + ".json"
    models.save_vocab(V.build_vocab(spark, stems(spark, d)), path)
    return models.load_vocab(spark, path)


def bpe_file(spark: SparkSession, d: str) -> DataFrame:
    """Byte pairs trained, saved and loaded again, in the hybrid tokenizer: the subwords of each distinct token."""
    path = new_file(spark, "bpe") + ".json"
    B.train(table(spark, d, "documents")).save(path)
    rows = _word_rows(spark, d, B.Model.load(path))
    return rows.select("text", "is_morph", "is_bpe", F.array_join(K.subwords("hybrid"), "|").alias("subwords"))


def _ids(spark: SparkSession, d: str, known: DataFrame) -> DataFrame:
    return K.encode_documents(table(spark, d, "documents"), stems(spark, d), A.default_affixes(spark), known)


def encode_ids(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid ids of every document."""
    ids = _ids(spark, d, V.build_vocab(spark, stems(spark, d)))
    return ids.select("doc_id", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def decode_ids(spark: SparkSession, d: str) -> DataFrame:
    """The text read back from the hybrid ids of every document."""
    known = V.build_vocab(spark, stems(spark, d))
    return V.decode(_ids(spark, d, known), known)


def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid ids of every document, cut to 64 and padded to the longest of its language."""
    ids = _ids(spark, d, V.build_vocab(spark, stems(spark, d)))
    lang = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    padded = B.pad_batch(ids.join(lang, "doc_id"), "lang", 64)
    return padded.select("doc_id", "lang", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


QUERIES = {
    q.__name__: q for q in (subword_frequency, subword_styles, token_stats, method_metrics, token_records, doc_subwords, unified_vocab, vocab_file, bpe_file, encode_ids, decode_ids, pad_truncate)
}

# ------------------------------------------------------------------ SQL
_RAW = f"""cut AS (SELECT doc_id, ts, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS pos
    FROM (SELECT doc_id, {S.raw_tokens(S.apostrophes(S.cleaned('text')))} AS ts FROM documents WHERE text IS NOT NULL)),
raw AS (SELECT doc_id, pos, text, {S.token_type('text')} AS token_type FROM cut),
kept AS (SELECT * FROM raw WHERE token_type <> 'whitespace'),
forms AS (SELECT text, {S.folded('text')} AS word FROM (SELECT DISTINCT text FROM kept WHERE token_type = 'word')),
words AS (SELECT DISTINCT word FROM forms)"""
_WITH = f"""WITH RECURSIVE {S.variants()}, {S.STEMS}, {_RAW}, {S.analysis('trie_ord', 1)}, names AS ({S.IDS.format(order='trie_ord')}),
known AS (SELECT f.text, f.word, coalesce(a.root, f.word) AS root, coalesce(a.found, FALSE) AS found, a.confidence, a.path,
    coalesce(list_transform(list_reverse(a.path), lambda o: texts[o]), []) AS sufs FROM forms f LEFT JOIN analyses_found a ON f.word = a.word, names),
shown AS (SELECT text, found, root, sufs, CASE WHEN found OR len(sufs) > 0 THEN {S.cased_like('root', 'text')} ELSE text END AS head FROM known)"""


def _sub(first: str, other: str) -> str:
    return f"list_prepend('{first}' || head, list_transform(sufs, lambda s: '{other}' || s))"


_ALL = f"""toks AS (SELECT k.doc_id, k.pos, k.text, k.token_type, s.found, s.root, s.sufs,
    CASE WHEN k.token_type = 'word' THEN {_sub('{first}', '{other}')} ELSE [k.text] END AS subs FROM kept k LEFT JOIN shown s ON k.token_type = 'word' AND k.text = s.text)"""


def _toks(style: str) -> str:
    first, other = K.STYLES[style]
    return _ALL.replace("{first}", first).replace("{other}", other)


_VOCAB = f"""parts AS (
  SELECT 0 AS section, i AS nth_in, t AS token FROM {{specials}}
  UNION ALL SELECT 1, i, t FROM {{marks}}
  UNION ALL SELECT 2, lin_ord, '##' || variant FROM variants
  UNION ALL SELECT 3, 0, 'Ġ' || stem FROM stem_list),
firsts AS (SELECT token, min(row(section, nth_in)) AS place FROM parts GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY place, token) - 1)::INTEGER AS id FROM firsts)"""
_VOCAB = _VOCAB.replace("{specials}", "(VALUES " + ", ".join(f"({i}, {S.quoted(t)})" for i, t in enumerate(V.SPECIALS)) + ") x(i, t)").replace(
    "{marks}", "(VALUES " + ", ".join(f"({i}, {S.quoted(t)})" for i, t in enumerate(V.MARKS)) + ") y(i, t)"
)
_IDS = f"""{_toks('hybrid')}, {_VOCAB},
subs AS (SELECT doc_id, pos, unnest(subs) AS sub, generate_subscripts(subs, 1) AS k FROM toks),
sub_ids AS (SELECT s.sub, coalesce(a.id, b.id, c.id, 1) AS id FROM (SELECT DISTINCT sub FROM subs) s
  LEFT JOIN vocab a ON a.token = s.sub
  LEFT JOIN vocab b ON starts_with(s.sub, 'Ġ') AND b.token = 'Ġ' || lower(s.sub[2:])
  LEFT JOIN vocab c ON c.token = lower(s.sub)),
ids AS (SELECT doc_id, pos, k, i.id FROM subs s JOIN sub_ids i ON s.sub = i.sub)"""

_SUFFIX = "{'text': texts[o], 'affix_id': ids[o], 'meaning_uz': meanings[o], 'meaning_en': meanings_en[o], 'affix_type': types[o], 'category': categories[o]}"
_CHAIN = "array_to_string(list_transform(p, lambda o: '+' || texts[o] || '(' || meanings[o] || ')'), ' -> ')"
_RECORD = f"""records AS (SELECT text, to_json({{'text': text, 'type': 'word', 'is_morph': found OR len(p) > 0, 'is_bpe': FALSE, 'morph': {{
      'original': CASE WHEN found OR len(p) > 0 THEN word ELSE text END, 'root': root, 'status': CASE WHEN found THEN 'found' ELSE 'unknown' END, 'is_compound': FALSE,
      'confidence': round(coalesce(confidence, 0), 3), 'suffixes': list_transform(p, lambda o: {_SUFFIX}), 'suffix_chain': {_CHAIN}}}}})::VARCHAR AS record
    FROM (SELECT *, coalesce(list_reverse(path), []) AS p FROM known), names)"""

SQL = {
    "token_records": f"""{_WITH}, {_RECORD} SELECT DISTINCT k.text, CASE WHEN k.token_type = 'word' THEN r.record
        ELSE to_json({{'text': k.text, 'type': k.token_type, 'is_morph': FALSE, 'is_bpe': FALSE}})::VARCHAR END AS record FROM kept k LEFT JOIN records r ON k.token_type = 'word' AND k.text = r.text""",
    "subword_frequency": f"{_WITH}, {_toks('hybrid')} SELECT subword, count(*) AS n FROM (SELECT unnest(subs) AS subword FROM toks) GROUP BY subword",
    "subword_styles": f"{_WITH} SELECT DISTINCT k.text, "
    + ", ".join(f"CASE WHEN k.token_type = 'word' THEN array_to_string({_sub(*K.STYLES[s])}, '|') ELSE k.text END AS {s}" for s in K.STYLES)
    + " FROM kept k LEFT JOIN shown s ON k.token_type = 'word' AND k.text = s.text",
    "token_stats": f"""{_WITH}, {_toks('hybrid')}, n AS (SELECT count(*) FILTER (token_type = 'word') AS total_tokens, count(*) FILTER (token_type = 'word' AND found) AS morph_found,
        count(*) FILTER (token_type = 'punctuation') AS punct_tokens FROM toks)
        SELECT total_tokens, morph_found, total_tokens - morph_found AS morph_not_found, 0::BIGINT AS bpe_used, punct_tokens, 0::BIGINT AS num_tokens,
        CASE WHEN total_tokens > 0 THEN printf('%.1f%%', morph_found / total_tokens * 100) ELSE 'N/A' END AS morph_accuracy, FALSE AS bpe_trained,
        (SELECT count(*) FROM stem_list) AS dictionary_size FROM n""",
    "method_metrics": f"""{_WITH}, {_toks('hybrid')} SELECT count(*) AS words, sum(len(subs))::BIGINT AS subwords, round(avg(len(subs)), 6) AS per_word,
        round(avg(found::INTEGER), 6) AS root_share FROM toks WHERE token_type = 'word'""",
    "doc_subwords": f"""{_WITH}, {_toks('plus')} SELECT doc_id, sum(len(subs))::INTEGER AS n, string_agg(array_to_string(subs, ' '), ' ' ORDER BY pos) AS strings FROM toks GROUP BY doc_id""",
    "vocab_file": f"WITH {S.variants()}, {S.STEMS}, {_VOCAB} SELECT token, id FROM vocab",
    "unified_vocab": f"WITH {S.variants()}, {S.STEMS}, {_VOCAB} SELECT token, id FROM vocab",
    "encode_ids": f"{_WITH}, {_IDS} SELECT doc_id, count(*)::INTEGER AS n, string_agg(id::VARCHAR, ' ' ORDER BY pos, k) AS ids FROM ids GROUP BY doc_id",
    "decode_ids": f"""{_WITH}, {_IDS}, pieces AS (SELECT i.doc_id, i.pos, i.k, v.token FROM ids i JOIN vocab v ON i.id = v.id WHERE i.id > 4),
        spaced AS (SELECT doc_id, pos, k, CASE WHEN starts_with(token, 'Ġ') THEN ' ' || token[2:] WHEN starts_with(token, '##') THEN token[3:] WHEN contains('.,!?:;', token) THEN token ELSE ' ' || token END AS piece FROM pieces)
        SELECT d.doc_id, coalesce(ltrim(string_agg(piece, '' ORDER BY pos, k), ' '), '') AS text FROM (SELECT DISTINCT doc_id FROM ids) d LEFT JOIN spaced s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    "pad_truncate": f"""{_WITH}, {_IDS}, lists AS (SELECT doc_id, list(id ORDER BY pos, k)[1:64] AS l FROM ids GROUP BY doc_id),
        j AS (SELECT l.doc_id, coalesce(d.lang, '') AS lang, l FROM lists l JOIN documents d ON l.doc_id = d.doc_id), m AS (SELECT lang, max(len(l)) AS m FROM j GROUP BY lang)
        SELECT doc_id, j.lang, m::INTEGER AS n, array_to_string(list_concat(l, list_resize([]::INTEGER[], m - len(l), 0)), ' ') AS ids FROM j JOIN m ON j.lang = m.lang""",
}
