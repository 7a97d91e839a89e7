"""Rates, character classes and words that the estimates, scores and cuts are defined by."""

CHARS_PER_TOKEN, DIGITS_PER_TOKEN, CJK_TOKENS, NEWLINE_TOKENS, SYMBOL_TOKENS = 4.0, 3.0, 1.0, 0.5, 0.6
#: Unicode white space, spelt out: \\s means less in Java, and \\v more.
SPACE = r"\u0009-\u000D\u001C- \u0085   -     　"
CJK = r"぀-ヿ㐀-䶿一-鿿가-힯"
STOPWORDS = frozenset(
    "is are was were be been being will would can could should may might do does did has have had "  # verbs
    "i he him his she her we our you your they them their it its this that these those there here "  # pronouns
    "a an the and or but if then else than so not no as at by for from in into of on to with "  # particles
    "who what when how which".split()
) - {"him"}
#: Scores are rounded before they order anything, so that the order doesn't hang on the last bit of a logarithm.
SCORE_DIGITS = 9
