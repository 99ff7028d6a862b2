"""Text columns: whitespace, words, folding for comparison, similarity.

Everything that can be an expression is one.  Python is used through Arrow, to fold
texts whose characters need Unicode compatibility normalisation and to find where their
folded characters come from.  Those functions are built by factories so that they travel
to executors by value.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the whitespace set and the characters folded together ----
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
APOSTROPHES = "‘’ʼ′"
QUOTATION_MARKS = "“”″"
DASHES = "‐‑‒–—―"
# ---- end of fixed values ----

SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
FOLD_FROM = APOSTROPHES + QUOTATION_MARKS + DASHES
FOLD_TO = "'" * len(APOSTROPHES) + '"' * len(QUOTATION_MARKS) + "-" * len(DASHES)

# Characters that compatibility normalisation leaves alone and that lower-case to
# one character, so a text made only of these can be folded by expressions: ASCII,
# stable Latin-1 and Latin Extended-A, basic Cyrillic, Han, kana and Hangul
# syllables, no-break space, and the quotes and dashes that fold one to one.
PLAIN_RANGES = (
    (0x00, 0x7F), (0x85, 0x85), (0xA0, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1),
    (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0xFF), (0x100, 0x12F), (0x134, 0x13E), (0x141, 0x148),
    (0x14A, 0x17E), (0x2BC, 0x2BC), (0x400, 0x45F), (0x2010, 0x2015), (0x2018, 0x2019),
    (0x201C, 0x201D), (0x2032, 0x2032), (0x3001, 0x3002), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)
PLAIN = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in PLAIN_RANGES) + "]"


def _plain_table() -> tuple[str, str]:
    """One character-to-character table for plain texts: spaces, quotes, dashes, case."""
    to = dict(zip(FOLD_FROM, FOLD_TO)) | {c: " " for c in SPACES if c != " "}
    for first, last in PLAIN_RANGES[:-2]:  # no case beyond kana
        for code in range(first, last + 1):
            c = chr(code)
            if c not in to and c.lower() != c:
                to[c] = c.lower()
    return "".join(to), "".join(to.values())


PLAIN_FROM, PLAIN_TO = _plain_table()
LISTED = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in FOLD_FROM + SPACES if c not in " \t\n\x0b\x0c\r") + "]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode white space at both ends."""
    return F.btrim(_c(c), F.lit(SPACES))


def squash(c: Column | str) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.btrim(F.regexp_replace(_c(c), SPACE_RUN, " "))


def words(c: Column | str) -> Column:
    """White-space separated words; empty array for blank text."""
    return F.filter(F.split(_c(c), SPACE_RUN), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    s = strip(c)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(s, SPACE_RUN))
    )


def beyond_ascii(c: Column | str) -> Column:
    """What is left of a text without its printable ASCII; little, in most texts."""
    return F.regexp_replace(_c(c), "[ -~]+", "")


def is_plain(c: Column | str, beyond: Column | None = None) -> Column:
    """True when expressions alone fold this text correctly; ASCII is told by its size.

    ``beyond`` is a column that holds ``beyond_ascii`` already, here and in the functions below.
    """
    c = _c(c)
    return (F.octet_length(c) == F.length(c)) | (beyond_ascii(c) if beyond is None else beyond).rlike(rf"\A{PLAIN}*+\z")


def fold_plain(c: Column | str, beyond: Column | None = None) -> Column:
    """Folded form of a plain text, entirely on the JVM.

    The table is only for texts with characters that lower case and line ends don't cover,
    since it takes each character by itself.
    """
    c = _c(c)
    listed = (beyond_ascii(c) if beyond is None else beyond).rlike(LISTED)
    spaced = F.when(listed, F.translate(c, PLAIN_FROM, PLAIN_TO)).otherwise(F.regexp_replace(F.lower(c), "[\t-\r]", " "))
    return F.btrim(F.regexp_replace(spaced, " {2,}", " "))


def _folder():
    """A function text -> (folded, starts, ends), offsets into the *original*.

    Works cluster by cluster (a base character and what combines with it), so a
    ligature, an ellipsis or a decomposed accent in front of a quote does not
    shift the offsets.
    """
    import unicodedata

    same = {ord(c): plain for group, plain in ((APOSTROPHES, "'"), (QUOTATION_MARKS, '"'), (DASHES, "-")) for c in group}
    nfkc = unicodedata.normalize

    def clusters(text):
        i, n = 0, len(text)
        while i < n:
            j = i + 1
            while j < n and text[j] > "\u02ff" and (
                unicodedata.combining(text[j])
                or nfkc("NFKC", text[i : j + 1])
                != nfkc("NFKC", text[i:j]) + nfkc("NFKC", text[j])
            ):
                j += 1
            yield i, j
            i = j

    def fold(text):
        # One row a cluster (start, end, normalised piece), then one a character of the pieces.
        table = [(i, j, nfkc("NFKC", text[i:j]).translate(same)) for i, j in clusters(text)]
        chars = [(c, row) for row in table for c in row[2]]
        space = [c.isspace() for c, _ in chars]
        # A white space stays where it follows a character that is none, unless only white space follows.
        kept = [k for k, white in enumerate(space) if not white or (k and not space[k - 1])]
        if kept and space[kept[-1]]:
            del kept[-1]
        shown = [" " if space[k] else chars[k][0].lower() for k in kept]
        offsets = [[chars[k][1][end] for k, c in zip(kept, shown) for _ in c] for end in (0, 1)]
        return "".join(shown), *offsets

    return fold


def _fold_udf():
    fold = _folder()

    @F.pandas_udf("string")
    def fold_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold(t)[0])

    return fold_text


def _offsets_udf():
    fold = _folder()

    @F.pandas_udf("array<int>")
    def offsets(texts: pd.Series, positions: pd.Series) -> pd.Series:
        """For folded positions: their starts, then their ends (all when null)."""

        def one(text, wanted):
            if text is None:
                return None
            _, starts, ends = fold(text)
            if wanted is None:
                return starts + ends
            return [starts[p] for p in wanted] + [ends[p] for p in wanted]

        return pd.Series([one(t, w) for t, w in zip(texts, positions)])

    return offsets


def fold(c: Column | str, plain: Column | None = None, beyond: Column | None = None, once: bool = False) -> Column:
    """Comparable form of any text.

    Only texts outside the plain set are handed to Python; the rest pass null to
    the Arrow batch and are folded by expressions.  ``plain`` is a column that holds
    ``is_plain`` already, so that the text is not looked through again.  ``once`` keeps
    conditions on the result from being pushed below it, where all texts would be folded
    a second time.
    """
    c = _c(c)
    folded = _fold_udf().asNondeterministic() if once else _fold_udf()
    return F.coalesce(folded(F.when(~(is_plain(c, beyond) if plain is None else plain), c)), fold_plain(c, beyond))


def fold_offsets(c: Column | str, positions: Column) -> Column:
    """Original (starts ++ ends) of the given folded positions."""
    return _offsets_udf()(_c(c), positions)


def border_grams(c: Column | str) -> Column:
    """Distinct grams across the word borders of a folded text.

    For every blank: the last one, two and three characters before it, the blank, and up
    to three characters behind it.
    """
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"(?=(\S{1,3} \S{1,3}))"), F.lit(1)))


def longest_block(a: Column, b: Column) -> Column:
    """The longest piece that two strings share: struct(size, a, b), places from 0.

    Its size is found by halving, since a shared piece holds shared pieces of every smaller
    size.  Of pieces of equal size the first in ``a`` counts, at its first place in ``b``.
    Places mean nothing where the size is 0.
    """
    most = F.least(F.length(a), F.length(b))
    shares = lambda k: F.exists(F.sequence(F.lit(1), F.length(a) - k + 1), lambda i: F.contains(b, F.substring(a, i, k)))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        kept = F.struct(middle.alias("lo"), s["hi"].alias("hi"))
        cut = F.struct(s["lo"].alias("lo"), (middle - 1).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(shares(middle), kept).otherwise(cut)

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(most + 1)).cast("int"), F.lit(1)))
    begin = F.struct(F.lit(0).alias("lo"), most.alias("hi"))
    size = F.aggregate(rounds, begin, halve, lambda s: s["lo"])

    def placed(k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(a) - k + 1, F.lit(1)))
        first = F.array_min(F.filter(starts, lambda i: F.contains(b, F.substring(a, i, k))))
        piece = lambda i: F.struct(k.alias("size"), (i - 1).alias("a"), (F.position(F.substring(a, i, k), b) - 1).alias("b"))
        return _bound(first, piece)

    return _bound(size, placed)


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matched blocks over the characters of both strings, 0 to 1.

    The longest shared piece is a block; what lies before it and what lies behind it is
    matched in the same way, by a fold over a stack of string pairs that are still open.
    Two empty strings have ratio 1.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def step(s: Column, _: Column) -> Column:
        top = F.element_at(s["open"], 1)
        rest = F.slice(s["open"], 2, F.length(a) + F.length(b))

        def matched(block: Column) -> Column:
            k, x, y = block["size"], block["a"], block["b"]
            before = pair(F.left(top["a"], x), F.left(top["b"], y))
            behind = pair(F.substr(top["a"], x + k + 1), F.substr(top["b"], y + k + 1))
            more = F.filter(F.array(before, behind), lambda p: (p["a"] != "") & (p["b"] != ""))
            return F.struct(F.when(k > 0, F.concat(more, rest)).otherwise(rest).alias("open"), (s["sum"] + k).alias("sum"))

        return F.when(F.size(s["open"]) == 0, s).otherwise(_bound(longest_block(top["a"], top["b"]), matched))

    begin = F.struct(F.filter(F.array(pair(a, b)), lambda p: (p["a"] != "") & (p["b"] != "")).alias("open"), F.lit(0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), 2 * F.length(a)), begin, step, lambda s: s["sum"])
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * total / both)


#: Pieces whose running length is taken in one array.
PIECES = 256


def occurrences(text: Column, needle: Column) -> Column:
    """Zero-based positions of every occurrence, overlapping ones included.

    The text is cut in front of each occurrence by a zero-width look-ahead, and the
    running length of the pieces gives the positions.  It is taken in chunks of
    ``PIECES`` pieces, since appending to one array would copy it for every hit.
    """
    literal = F.concat(
        F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")
    )
    lengths = F.transform(F.split(text, literal), lambda p: F.length(p))
    chunks = _bound(
        lengths,
        lambda all_: F.transform(
            F.sequence(F.lit(1), F.size(all_), F.lit(PIECES)), lambda at: _running(F.slice(all_, at, PIECES))
        ),
    )
    starts = _bound(
        chunks,
        lambda parts: F.flatten(
            F.zip_with(
                parts,
                F.slice(_running(F.transform(parts, lambda c: F.element_at(c, -1))), 1, F.size(parts)),
                lambda c, lift: F.transform(F.slice(c, 1, F.size(c) - 1), lambda p: p + lift),
            )
        ),
    )
    return F.filter(starts, lambda p, i: (i > 0) | F.startswith(text, needle))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(numbers: Column) -> Column:
    """0 and the running sums of an array."""
    return F.aggregate(
        numbers,
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )


def fold_valence(c: Column | str) -> Column:
    """Spelled-out and one-letter valences to the four names; blank stays blank."""
    from weftline.schema import VALENCE_SPELLINGS

    v = F.lower(strip(F.coalesce(_c(c), F.lit(""))))
    folded = v
    for spelling, name in VALENCE_SPELLINGS.items():
        folded = F.when(v == spelling, F.lit(name)).otherwise(folded)
    return folded


def value_shape(c: Column | str) -> Column:
    """A value with its content masked and its form kept: ``Ann B12`` -> ``Aa Aa##``."""
    s = F.substring(_c(c), 1, 48)
    masked = F.regexp_replace(s, "(?<![A-Za-z])[A-Z][A-Za-z]*", "\u0001")
    masked = F.regexp_replace(masked, "[A-Za-z]+", "aa")
    masked = F.regexp_replace(masked, "\u0001", "Aa")
    return F.regexp_replace(masked, "[0-9]+", "##")


def has_wide(c: Column | str) -> Column:
    """Any character beyond the basic plane."""
    return _c(c).rlike(r"[\x{10000}-\x{10FFFF}]")
