"""SQL fragments for the comparison queries (RE2 has neither look-around nor back references)."""

from __future__ import annotations

from qatlam.functions import charsets as C
from qatlam.sources import lexicon


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(x: str, *steps: tuple[str, str]) -> str:
    """``x`` with each pattern replaced everywhere, one after the other."""
    for pattern, by in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return x


_PAIR = ("([a-zA-Z])'([a-zA-Z])", r"\1ʼ\2")


def apostrophes(x: str) -> str:
    plain = f"translate({x}, {quoted(C.APOSTROPHES)}, {quoted(chr(39) * len(C.APOSTROPHES))})"
    return replaced(plain, ("([oOgG])'", r"\1ʻ"), _PAIR, _PAIR)


def collapsed(x: str) -> str:
    return f"trim({replaced(x, (f'[{C.WIDE_SPACE}]+', ' '))}, ' ')"


def folded(x: str) -> str:
    """Dictionary spelling of text in NFKC."""
    return collapsed(replaced(f"lower({apostrophes(x)})", (f"([og])[{C.SPACE}]+['ʻʼ][{C.SPACE}]*", r"\1ʻ")))


def cleaned(x: str) -> str:
    dots = (r"(^|[^.])\.\.([^.]|$)", r"\1.\2")
    url = rf'(?i)(https?://|ftp://|www\.)([^{C.SPACE}<>"]+?)([.,!?;:]?)([{C.SPACE}]|$)'
    doubled = [(f"{c}{{2,}}", c.strip("\\")) for c in ("!", r"\?", ",", ";", ":", "—", "–")]
    return collapsed(
        replaced(
            x, ("<[^>]+>", " "), (url, r" \3\4"), (r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\b", " "), ("[-=~*#^_]{2,}", " "), (r"\.{4,}", "..."), dots, dots,
            (r"(?:!\?|\?!)[!?]+", "?!"), *doubled, ("\"{2,}|'{2,}", "'"), (f"[{C.SPACE}]+([.,!?:;])", r"\1"),
        )
    )


RAW_TOKEN = f"[{C.WORD}'ʻʼ]+|[^{C.WORD}{C.SPACE}'ʻʼ]+|[{C.SPACE}]+"
# a straight apostrophe after o or g is never left by the spelling rules
PRE_TOKEN = rf"[{C.LETTER}]+(?:'[{C.LETTER}]+)*|\p{{Nd}}+|[^{C.SPACE}{C.WORD}]"
PRE_TOKEN_OR_SPACE = PRE_TOKEN + f"|[{C.SPACE}]+"


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(RAW_TOKEN)})"


def pre_tokens(x: str, with_space: bool = False) -> str:
    return f"regexp_extract_all({apostrophes(x)}, {quoted(PRE_TOKEN_OR_SPACE if with_space else PRE_TOKEN)})"


def token_type(x: str) -> str:
    word, space = quoted(f"^[{C.WORD}''ʻʼ]".replace("''", "'")), quoted(f"^[{C.SPACE}]")
    return f"CASE WHEN regexp_matches({x}, {word}) THEN 'word' WHEN regexp_matches({x}, {space}) THEN 'whitespace' ELSE 'punctuation' END"


def is_title(x: str) -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return f"(regexp_matches({x}, '[{cased}]') AND NOT regexp_matches({x}, '(^|[^{cased}])\\p{{Ll}}') AND NOT regexp_matches({x}, '[{cased}][\\p{{Lu}}\\p{{Lt}}]'))"


def is_upper(x: str) -> str:
    return f"(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def cased_like(root: str, x: str) -> str:
    return f"CASE WHEN {is_title(x)} THEN upper({root}[1]) || lower({root}[2:]) WHEN {is_upper(x)} THEN upper({root}) ELSE {root} END"


def transliterated(x: str) -> str:
    """Letter by letter, with the neighbours at hand."""
    capitals = quoted("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + C.CYRILLIC_CAPITALS)

    def at(k: str) -> str:
        return f"CASE WHEN {k} BETWEEN 1 AND length({x}) THEN {x}[{k}] ELSE '' END"

    def capital(c: str) -> str:
        return f"({c} <> '' AND contains({capitals}, {c}))"

    c, before, after = f"{x}[i]", f"({at('i - 1')})", f"({at('i + 1')})"
    among = f"({capital(c)} AND ({capital(after)} OR ({capital(before)} AND NOT regexp_matches({after}, '\\p{{Ll}}'))))"
    start = f"(NOT regexp_matches({before}, '\\p{{L}}') OR contains({quoted(C.CYRILLIC_VOWELS + C.IOTATING_SIGNS)}, {before}))"
    cases = [f"WHEN {c} = 'е' THEN CASE WHEN {start} THEN 'ye' ELSE 'e' END", f"WHEN {c} = 'Е' THEN CASE WHEN NOT {start} THEN 'E' WHEN {among} THEN 'YE' ELSE 'Ye' END"]
    for letter, (low, title, high) in C.DIGRAPHS.items():
        cases += [f"WHEN {c} = '{letter}' THEN '{low}'", f"WHEN {c} = '{letter.upper()}' THEN CASE WHEN {among} THEN '{high}' ELSE '{title}' END"]
    cases += [f"WHEN {c} = '{a}' THEN '{b}'" for a, b in C.COMMA_LETTERS.items()]
    single = f"translate({c}, {quoted(C.SINGLE_FROM)}, {quoted(C.SINGLE_TO)})"
    return f"CASE WHEN length({x}) = 0 THEN {x} ELSE list_aggregate(list_transform(range(1, length({x}) + 1), lambda i: CASE {' '.join(cases)} ELSE {single} END), 'string_agg', '') END"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(quoted, v)) + "]"
        return quoted(v) if isinstance(v, str) else str(v)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def variants(name: str = "variants") -> str:
    """The default affixes by variant with both orders, as CTEs."""
    rows = [(n, k, i, uz, en, t, c, p, v, f.split() or None) for n, (i, _, uz, en, t, c, vs, f, p) in enumerate(lexicon.AFFIXES) for k, v in enumerate(vs.split())]
    listed = values("raw_variants", "n, k, affix_id, meaning_uz, meaning_en, affix_type, category, priority, variant, follows", rows)
    return f"""{listed},
listed AS (SELECT *, row_number() OVER (ORDER BY length(variant) DESC, priority DESC, n, k) AS lin_ord FROM raw_variants),
{name} AS (SELECT *, row_number() OVER (ORDER BY length(variant) DESC, lin_ord DESC) AS trie_ord FROM listed)"""


STEMS = f"stem_list AS (SELECT DISTINCT {folded('stem')} AS stem FROM stems WHERE stem IS NOT NULL AND {folded('stem')} <> '')"
WORDS = f"words AS (SELECT DISTINCT {folded('text')} AS word FROM tokens WHERE token_type = 'word' AND text IS NOT NULL)"


def analysis(order: str = "trie_ord", max_results: int = 1, depth: int = 15) -> str:
    """CTEs from words, stem_list and variants to ``analyses_found(word, rank, root, path, found, confidence)``."""
    changes = values("sound_changes", "surface, canonical", list(lexicon.SOUND_CHANGES.items()))
    fits = """CASE WHEN v.variant IN ('qa','qan','qach','ka','kan','kach') THEN right({stem}, 1) IN ('k','q')
                   WHEN v.variant IN ('ga','gan','gach') THEN right({stem}, 1) NOT IN ('k','q') ELSE TRUE END"""
    rest = "left(s.rem, length(s.rem) - length(v.variant))"
    step = f"""FROM {{name}} s JOIN variants v ON suffix(s.rem, v.variant)
      WHERE len(s.path) < {{depth}} AND length(s.rem) - length(v.variant) >= 2 AND (s.follows IS NULL OR list_contains(s.follows, v.category))"""
    score = """list_reduce(list_prepend(({base}), list_transform(path, lambda o: prios[o] * 0.001::DOUBLE)), lambda a, b: a + b)"""
    base = """{half} least(0.3::DOUBLE, length(root) * 0.05::DOUBLE) + CASE WHEN len(path) = 0 THEN 0.2::DOUBLE WHEN len(path) <= 2 THEN 0.15::DOUBLE WHEN len(path) <= 4 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"""
    return f"""{changes},
prio AS (SELECT list(priority ORDER BY {order}) AS prios FROM variants),
state AS (
  SELECT word, word AS rem, []::BIGINT[] AS path, NULL::VARCHAR[] AS follows, NULL::VARCHAR AS leftmost FROM words
  UNION ALL
  SELECT s.word, {rest}, list_append(s.path, v.{order}), v.follows, v.variant {step.format(name='state', depth=depth)} AND {fits.format(stem=rest)}),
form AS (
  SELECT s.*, 0 AS nth, rem AS stem FROM state s
  UNION ALL SELECT s.*, 1, c.canonical FROM state s JOIN sound_changes c ON s.rem = c.surface WHERE len(path) > 0
  UNION ALL SELECT s.*, 2, left(rem, length(rem) - 2) || 'q' FROM state s WHERE len(path) > 0 AND (suffix(rem, 'gʻ') OR suffix(rem, 'g'''))
  UNION ALL SELECT s.*, 3, left(rem, length(rem) - 1) || 'k' FROM state s WHERE len(path) > 0 AND suffix(rem, 'g')),
hit AS (SELECT word, path, leftmost, min_by(f.stem, nth) AS root FROM form f JOIN stem_list t ON f.stem = t.stem GROUP BY word, path, leftmost),
valid AS (SELECT word, path, root FROM (SELECT *, leftmost AS variant FROM hit) v WHERE leftmost IS NULL OR ({fits.format(stem='v.root')})),
early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY path) AS nth FROM valid) WHERE nth <= {2 * max_results}),
scored AS (SELECT word, path, root, TRUE AS found, {score.format(base=base.format(half='0.5::DOUBLE +'))} AS confidence FROM early, prio),
unknown_word AS (SELECT word FROM words WHERE word NOT IN (SELECT word FROM valid)),
loose AS (
  SELECT word, word AS rem, []::BIGINT[] AS path, NULL::VARCHAR[] AS follows FROM unknown_word
  UNION ALL
  SELECT s.word, {rest}, list_append(s.path, v.{order}), v.follows {step.format(name='loose', depth=5)}),
guessed AS (SELECT word, path, rem AS root FROM loose WHERE len(path) > 0),
scored_guess AS (SELECT word, path, root, FALSE AS found, {score.format(base=base.format(half=''))} AS confidence FROM guessed, prio),
analyses_found AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY confidence DESC, path) AS rank FROM (SELECT * FROM scored UNION ALL SELECT * FROM scored_guess)) WHERE rank <= {max_results})"""


def affix_ids() -> str:
    """A list of the affix ids of ``path`` from left to right."""
    return "list_transform(list_reverse(path), lambda o: ids[o])"


IDS = "SELECT list(affix_id ORDER BY {order}) AS ids, list(variant ORDER BY {order}) AS texts, list(meaning_uz ORDER BY {order}) AS meanings, list(meaning_en ORDER BY {order}) AS meanings_en, list(affix_type ORDER BY {order}) AS types, list(category ORDER BY {order}) AS categories FROM variants"
