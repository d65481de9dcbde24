"""Character classes and fixed letter tables shared by the expressions."""

from __future__ import annotations

# Characters used for an apostrophe, official ones first.
APOSTROPHES = "ʻʼ’‘`ʹ′ʿ'´ʾ‛‚‵＇ˊˋˈʽ\u0092"

# Regular-expression classes, without brackets, that mean the same in Java, RE2 and Python.
#: A word character: letters, numbers and the underscore.
WORD = r"\p{L}\p{N}_"
#: A letter of a pre-token: letters and the numbers that aren't decimal digits.
LETTER = r"\p{L}\p{Nl}\p{No}"
#: White space.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space and the invisible characters that are taken for it.
WIDE_SPACE = SPACE + r"\x{200b}\x{200c}\x{200d}\x{feff}"

# Cyrillic capitals that count as such beside A to Z, and the vowels.
CYRILLIC_CAPITALS = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЎҚҒҲ"
CYRILLIC_VOWELS = "аеёиоуэюяўАЕЁИОУЭЮЯЎ"
#: Signs after which a Cyrillic е is iotated like after a vowel.
IOTATING_SIGNS = "'ʼ`ʻъЪьЬ’"

# Single letters and their Latin spelling. The soft sign has none.
SINGLE_FROM = "абвгджзийклмнопрстуфхыэқҳъіАБВГДЖЗИЙКЛМНОПРСТУФХЫЭҚҲЪІьЬ"
SINGLE_TO = "abvgdjziyklmnoprstufxieqhʼiABVGDJZIYKLMNOPRSTUFXIEQHʼI"
#: Letters spelled with the turned comma.
COMMA_LETTERS = {"ў": "oʻ", "ӯ": "oʻ", "ғ": "gʻ", "ґ": "gʻ", "Ў": "Oʻ", "Ӯ": "Oʻ", "Ғ": "Gʻ", "Ѓ": "Gʻ"}
#: Letters spelled with two letters: small, capital before small letters, among capitals.
DIGRAPHS = {"ё": ("yo", "Yo", "YO"), "ц": ("ts", "Ts", "TS"), "ч": ("ch", "Ch", "CH"), "ш": ("sh", "Sh", "SH"), "щ": ("sh", "Sh", "SH"), "ю": ("yu", "Yu", "YU"), "я": ("ya", "Ya", "YA")}
