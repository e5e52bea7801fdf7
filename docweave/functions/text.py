"""Scalar text functions as Catalyst expressions (Column -> Column).

Regex flavour: Spark runs java.util.regex. Python's Unicode ``\\s``/``\\w`` are
spelled out as explicit classes (``WS``, ``WORD``) so that Spark, DuckDB (RE2)
and Python agree on accented text and U+00A0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, spelled out (Python's str \s; Java needs it explicit).
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"

# ---------------------------------------------------------------------------
# These must equal the reference's lists for identical output.
# Navigation patterns searched (case-insensitive) in paragraph text; the
# second list adds one pattern.
NAV_PATTERNS = [
    r"contact\s+us", r"click\s+(here|for)", r"guidance", r"help", r"support",
    r"assistance", r"maximize\s+screen", r"view\s+details", r"read\s+more",
    r"convert.*file", r"FAQ", r"learn\s+more",
]
NAV_PATTERNS_FULL = NAV_PATTERNS + [
    r"Click\s+here\s+to\s+see\s+this\s+page\s+in\s+full\s+context",
]
# Filler phrases deleted from page text (case-insensitive).
FILLER_PATTERNS = [
    r"End of search results\.?",
    r"Click\s+here\s+to\s+see\s+this\s+page\s+in\s+full\s+context",
]
# Navigation labels deleted from page text (case-insensitive, whole words).
NAV_LABELS = [r"\bBack Forward\b", r"\bApplication Look\b"]
# Help-system phrases that carry the documented product's name and version;
# they are built from the caller's ``product`` / ``version`` (see
# ``product_fillers``), so the corpus' product is configuration, not code.
PRODUCT_FILLER_FORMS = ["{product} Help {version}\\s*%", "{product} Help {version}"]
PRODUCT_LABEL_FORMS = ["\\b{product} Help\\b", "\\b{product} License and Version Number\\b"]
APOLOGY_PATTERN = r"please accept our apologies\.?"
# Lines dropped exactly (after trimming) from line-split page text.
BOILERPLATE_LINES = [
    "Click here to see this page in full context",
    "*Maximize screen to view table of contents*",
    "Back", "Forward",
    "ODF Template File (ODT)",
]
# Cell values of a navigation-only table (lower-cased, stripped).
NAV_TABLE_CELLS = ["back", "forward", "", "-", "next", "previous"]
NAV_TABLE_CELLS_SHORT = ["back", "forward"]
# English stop words (scikit-learn's list is not available offline; this is
# the NLTK English list, which the reference uses for keyword heads).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above "
    "below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don don't should "
    "should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't "
    "doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn "
    "wasn't weren weren't won won't wouldn wouldn't"
).split()
# ---------------------------------------------------------------------------


def _alt(patterns: list[str]) -> str:
    return "|".join(patterns)


# The same White_Space set as characters, for plain (non-regex) trimming.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def ustrip(c: Column) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends (a
    character-set trim, no regex)."""
    return F.btrim(c, F.lit(WS_CHARS))


def normalize_whitespace(c: Column) -> Column:
    """Runs of whitespace -> one space, trimmed."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def squeeze_blank_lines(c: Column) -> Column:
    """Any blank-line run (newline, whitespace, newline...) -> one blank line."""
    return F.regexp_replace(c, rf"\n{WS}*\n+", "\n\n")


def collapse_repeated_phrases(c: Column) -> Column:
    """An immediately repeated phrase of 2-6 words is kept once
    (case-insensitive, back-reference; no RE2 equivalent)."""
    return F.regexp_replace(
        c, rf"(?iU)\b((?:{WORD}+{WS}+){{1,5}}?{WORD}+){WS}+\1\b", "$1"
    )


def product_fillers(product: str | None, version: str | None) -> tuple[list[str], list[str]]:
    """Filler and label patterns for the documented product (empty when no
    product is given)."""
    import re as _re
    if not product:
        return [], []
    p = _re.escape(product)
    v = _re.escape(version) if version else ""
    fillers = [f.format(product=p, version=v) for f in PRODUCT_FILLER_FORMS] if version else []
    labels = [f.format(product=p) for f in PRODUCT_LABEL_FORMS]
    return fillers, labels


def strip_fillers(c: Column, product: str | None = None, version: str | None = None) -> Column:
    """Delete filler phrases, then navigation labels (case-insensitive).
    ``product`` / ``version`` add the help system's own name phrases."""
    pf, pl = product_fillers(product, version)
    c = F.regexp_replace(c, "(?iU)" + _alt(pf + FILLER_PATTERNS), "")
    return F.regexp_replace(c, "(?iU)" + _alt(pl + NAV_LABELS), "")


def collapse_ellipsis(c: Column) -> Column:
    """Two or more dots -> one dot; the apology phrase is deleted."""
    c = F.regexp_replace(c, r"\.{2,}", ".")
    return F.regexp_replace(c, "(?i)" + APOLOGY_PATTERN, "")


def split_sentences(c: Column) -> Column:
    """Split after ``.``, ``?`` or ``!`` followed by whitespace."""
    return F.split(c, rf"(?<=[.?!]){WS}+")


def regroup_paragraphs(c: Column) -> Column:
    """Sentences accumulate into paragraphs that flush when a sentence is short
    or ends with a stop mark; every split piece but the last ends with one, so
    this is one paragraph per non-empty stripped sentence, blank-line joined."""
    parts = F.transform(split_sentences(c), ustrip)
    return F.array_join(F.filter(parts, lambda s: s != ""), "\n\n")


def space_before_url(c: Column) -> Column:
    """Insert a space between a lower-case letter and a glued URL."""
    return F.regexp_replace(c, r"([a-z])(?=https?://|www\.)", "$1 ")


def fix_punctuation_spacing(c: Column) -> Column:
    """No space before ``.,!?``; one space after it when a word char follows."""
    c = F.regexp_replace(c, rf"{WS}+([.,!?])", "$1")
    return F.regexp_replace(c, rf"([.,!?])(?={WORD})", "$1 ")


def has_min_words(c: Column, n: int) -> Column:
    """``len(s.split()) >= n`` as one anchored regex test (no split)."""
    if n <= 0:
        return F.lit(True)
    nonws = WS.replace("[", "[^", 1)
    return F.coalesce(c.rlike(rf"^{WS}*(?:{nonws}+{WS}+){{{n - 1}}}{nonws}"), F.lit(False))


def drop_filler_sentences(c: Column, min_words: int = 5) -> Column:
    """Keep sentences with at least ``min_words`` words that do not start with
    "did you know"; newline-joined. (Sentence model re-aimed to the regex
    splitter.)"""
    kept = F.filter(
        F.transform(split_sentences(c), ustrip),
        lambda s: has_min_words(s, min_words) & ~F.lower(s).startswith("did you know"),
    )
    return F.array_join(kept, "\n")


URL_PATTERN = r"(https?://[^\s]+|www\.[^\s]+)"


def space_entities(c: Column) -> Column:
    """Pad entities with spaces and collapse whitespace. No NER model is
    available offline, so the entity set is URLs (the reference's URL class)."""
    return F.regexp_replace(F.regexp_replace(c, URL_PATTERN, " $1 "), rf"{WS}+", " ")


def clean_bullets(c: Column) -> Column:
    """Split at each bullet mark; every bullet cleaned and one per line."""
    pieces = F.filter(F.split(c, "(?=•)"), lambda s: s.startswith("•"))
    cleaned = F.transform(
        pieces,
        lambda s: F.concat(
            F.lit("• "), normalize_whitespace(space_entities(s)),
        ),
    )
    return F.array_join(cleaned, "\n")


def render_answer(c: Column) -> Column:
    """``**x**`` -> ``<b>x</b>``; newline -> ``<br>``."""
    return F.replace(
        F.regexp_replace(c, r"\*\*([^\n]*?)\*\*", "<b>$1</b>"), F.lit("\n"), F.lit("<br>")
    )


def truncate_title(c: Column, max_words: int = 8) -> Column:
    """More than ``max_words`` words -> the first ``max_words`` plus ``...``."""
    words = F.filter(F.split(ustrip(c), rf"{WS}+"), lambda w: w != "")
    return F.when(
        F.size(words) > max_words,
        F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("...")),
    ).otherwise(ustrip(c))


def null_to_empty(c: Column) -> Column:
    """null / NaN -> ''; everything else as its string form."""
    text = c.cast("string")
    missing = c.isNull() | (F.typeof(c).isin("float", "double") & (text == "NaN"))
    return F.when(missing, F.lit("")).otherwise(text)


def tokens(c: Column) -> Column:
    """Lower-case word tokens (Unicode ``\\w+``)."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), 0)


def content_tokens(c: Column) -> Column:
    """Alphanumeric, non-stop-word lower-case tokens."""
    # isin over many literals is planned as a hash-set lookup (InSet)
    return F.filter(
        F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0),
        lambda t: ~t.isin(*STOP_WORDS),
    )


def _deaccent_table() -> tuple[str, str]:
    """Rule-built table: every Latin letter in U+00C0..U+024F whose canonical
    decomposition is one base letter plus combining marks maps to that base
    letter (what NFD + dropping marks does to it)."""
    import unicodedata
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_DEACCENT_SRC, _DEACCENT_DST = _deaccent_table()


def deaccent(c: Column) -> Column:
    """Strip accents from Latin letters (one ``translate``, JVM-side)."""
    return F.translate(c, _DEACCENT_SRC, _DEACCENT_DST)


def topic_tokens(c: Column, min_len: int = 2, max_len: int = 15) -> Column:
    """Tokens for topic models: de-accented, lower-case alphabetic runs of
    ``min_len``..``max_len`` letters, stop words removed. (Lemmatisation needs
    a lexicon that is not available offline; tokens are used as they are.)"""
    toks = F.regexp_extract_all(deaccent(F.lower(c)), F.lit(r"[\p{L}]+"), 0)
    return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len)
                    & ~t.isin(*STOP_WORDS))


# A written token: a number with its inner marks, or word characters held
# together by hyphens, dots and slashes. Such a compound is one token.
WRITTEN_TOKEN = rf"\p{{N}}+(?:[,:.]\p{{N}}+)+|{WORD}+(?:[-./]{WORD}+)*"


def keyword_head(c: Column, top_n: int = 3) -> Column:
    """First ``top_n`` keywords joined by a space: tokens are cut first, and
    those that are not purely letters and digits (``e-mail``, ``3.14``) or are
    stop words are dropped whole."""
    def kept(text):
        toks = F.regexp_extract_all(F.lower(text), F.lit(WRITTEN_TOKEN), 0)
        return F.slice(F.filter(toks, lambda t: t.rlike(r"^[\p{L}\p{N}]+$") & ~t.isin(*STOP_WORDS)), 1, top_n)

    # no token reaches over a blank, so the first of a text are those of its
    # beginning up to one, if that has enough of them
    begin = kept(F.regexp_extract(c, r"(?s)^.{0,400}(?= )", 0))
    return F.array_join(F.when(F.size(begin) >= top_n, begin).otherwise(kept(c)), " ")


def nav_match(c: Column, full: bool = False) -> Column:
    """True when the text contains any navigation pattern."""
    pats = NAV_PATTERNS_FULL if full else NAV_PATTERNS
    # no \w or \b in these patterns: Unicode case folding (?iu) is enough.
    # The lookahead on the possible first letters (folded the same way) lets
    # most positions fail on one class test instead of every alternative.
    first = "".join(sorted({p[0].lower() for p in pats}))
    regex = f"(?iu)(?=[{first}])(?:" + _alt(pats).replace(r"\s", WS).replace(".*", r"[^\n]*") + ")"
    return F.coalesce(c.rlike(regex), F.lit(False))


def body_slice(html: Column) -> Column:
    """Text between ``<body>`` and ``</body>``; a missing tag means that end of
    the page (the reference's ``find`` of -1 would cut at 5 / the last char;
    callers can flag it with ``body_missing``)."""
    start = F.instr(html, "<body>")
    end = F.instr(html, "</body>")
    from_ = F.when(start > 0, start + 6).otherwise(F.lit(1))
    to = F.when(end > 0, end).otherwise(F.length(html) + 1)
    return F.when(to >= from_, F.substring(html, from_, to - from_)).otherwise(F.lit(""))


def body_missing(html: Column) -> Column:
    return (F.instr(html, "<body>") == 0) | (F.instr(html, "</body>") == 0)


def html_links(html: Column) -> Column:
    """Every ``href`` of an ``<a>`` tag (double-quoted), document order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)
