"""Column functions on text: folding, tokens, patterns, excerpts, light stemming."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrasieve.config import vocab


def _accent_table() -> tuple[str, str]:
    """Every Latin letter whose canonical form is a base letter plus marks, and the marks."""
    accented, plain = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and all(unicodedata.combining(m) for m in marks):
            accented.append(chr(point))
            plain.append(base)
    marks = [chr(p) for p in range(0x300, 0x370) if unicodedata.combining(chr(p))]
    return "".join(accented + marks), "".join(plain)


def _compat_table() -> tuple[str, str]:
    """Single characters that compatibility folding turns into one ASCII letter or digit."""
    pairs = [(chr(p), unicodedata.normalize("NFKD", chr(p))) for p in (*range(0xA0, 0xC0), *range(0x2070, 0x20A0))]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and d.isascii() and d.isalnum()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_ACCENTED, _PLAIN = _accent_table()
_COMPAT, _COMPAT_PLAIN = _compat_table()


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def fold_word(word: str) -> str:
    """Driver-side twin of :func:`fold` for literals such as stopwords."""
    return strip_accents(word.lower())


def fold(text: Column, compat: bool = False) -> Column:
    """Lower case without accents; ``compat`` also maps characters such as ``º`` to ``o``."""
    if compat:
        return F.translate(F.lower(text), _COMPAT + _ACCENTED, _COMPAT_PLAIN + _PLAIN)
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def clean(text: Column, stopwords: Sequence[str] = tuple(vocab.STOPWORDS_CLEAN), min_len: int = 3) -> Column:
    """Folded words and numbers without stopwords and short tokens, joined by one space."""
    stop = sorted({fold_word(w) for w in stopwords})
    words = F.split(F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit("")), compat=True), "[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(stop))
    return F.array_join(kept, " ")


def tokens(text: Column, stopwords: Sequence[str] = tuple(vocab.STOPWORDS_TOKEN), min_len: int = 3) -> Column:
    """Array of folded alphabetic tokens in text order."""
    stop = sorted({fold_word(w) for w in stopwords})
    found = F.regexp_extract_all(fold(text), F.lit("[a-z]{%d,}" % min_len), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def raw_tokens(text: Column) -> Column:
    """Array of letter runs, accents kept (exploration variant)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-ZÀ-ÿ]+"), F.lit(0))


def strip_boilerplate(text: Column, prefixes: Sequence[str] = vocab.BOILERPLATE_PREFIXES, rounds: int = 3) -> Column:
    """Remove stacked formula openings, one hit per prefix and round, then squeeze blanks."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    for _ in range(rounds):
        for prefix in prefixes:
            out = F.regexp_replace(out, "(?iU)" + prefix, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def text_key(text: Column) -> Column:
    """Key under which texts that differ only in case, accents or punctuation are equal."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit("")), compat=True), "[^a-z0-9]+", " "))


def ngrams(tokens_col: Column, n_min: int = 1, n_max: int = 4) -> Column:
    """Array of word n-grams joined by a space, shorter ones first.

    ``tokens_col`` should be a plain column: an expression would be evaluated once per gram.
    """

    def of_size(n: int) -> Column:
        def gram(word: Column, i: Column) -> Column:
            words = [word] + [F.get(tokens_col, i + F.lit(k)) for k in range(1, n)]
            return F.when(F.get(tokens_col, i + F.lit(n - 1)).isNotNull(), F.concat_ws(" ", *words))

        return F.filter(F.transform(tokens_col, gram), lambda g: g.isNotNull())

    sizes = [tokens_col if n == 1 else of_size(n) for n in range(n_min, n_max + 1)]
    return F.concat(*sizes)


def type_token_ratio(tokens_col: Column) -> Column:
    return F.size(F.array_distinct(tokens_col)) / F.greatest(F.size(tokens_col), F.lit(1))


def keyword_overlap(tokens_col: Column, keywords: Sequence[str] = tuple(vocab.ENGINEERING_KEYWORDS)) -> Column:
    """Number of distinct tokens that are keywords."""
    words = sorted(set(keywords))
    return F.size(F.array_distinct(F.filter(tokens_col, lambda w: w.isin(words))))


def domain_term_count(cleaned: Column, terms: Sequence[str] = vocab.DOMAIN_TERMS, whole_word: bool = False) -> Column:
    """How many of ``terms`` occur in cleaned text, as substrings or as whole words."""
    padded = F.concat(F.lit(" "), cleaned, F.lit(" "))
    hits = [padded.contains(f" {t.strip()} ") if whole_word else cleaned.contains(t) for t in terms]
    return sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))


def normalise_document(text: Column) -> Column:
    """Undo hyphenation at line ends, join wrapped lines, squeeze blanks; keep paragraphs."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"-\s*\n\s*", "")
    out = F.regexp_replace(out, r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(out, r"[ \t]+", " ")


def marker_columns(
    text: Column,
    families: Mapping[str, Sequence[str]] = vocab.MARKERS_BASE,
    prefix: str = "mk_",
    strict_acronyms: bool = False,
    flags: str = "(?iU)",
) -> list[Column]:
    """Occurrence count per family.

    All counts sit in one projection, so a text is read once. By default patterns match in
    any case; ``strict_acronyms`` keeps capital words such as ``ART`` case sensitive. On folded
    text the plain ``(?i)`` flag is enough and cheaper.
    """
    flag = "(?U)" if strict_acronyms else flags
    columns = []
    for name, patterns in families.items():
        counts = [F.regexp_count(text, F.lit(flag + p)) for p in patterns]
        columns.append(F.coalesce(sum(counts[1:], counts[0]), F.lit(0)).alias(f"{prefix}{name}"))
    return columns


def marker_score(families: Mapping[str, Sequence[str]] = vocab.MARKERS_BASE, prefix: str = "mk_") -> Column:
    """Number of families present, over columns made by :func:`marker_columns`."""
    flags = [(F.col(f"`{prefix}{name}`") > 0).cast("int") for name in families]
    return sum(flags[1:], flags[0])


def first_pattern(text: Column, patterns: Sequence[str] = vocab.OBVIOUS_PATTERNS, flags: str = "(?i)") -> Column:
    """First pattern of the list that occurs in the text, else null.

    The text is folded, so accents of the patterns are taken off as well; the answer is the pattern as given.
    One alternation screens the rows first; most texts hit nothing and stop there.
    """
    plain = [strip_accents(p) for p in patterns]
    screen = text.rlike(flags + "(?:" + "|".join(plain) + ")")
    chain = F.coalesce(*[F.when(text.rlike(flags + q), F.lit(p)) for p, q in zip(patterns, plain)])
    return F.when(screen, chain)


def has_any(text: Column, patterns: Sequence[str] = vocab.COMPANY_NAME_PATTERNS, flags: str = "(?i)") -> Column:
    return F.coalesce(text.rlike(flags + "(?:" + "|".join(patterns) + ")"), F.lit(False))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    hits = [text.contains(t) for t in terms]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def work_nature(
    text: Column,
    special: Sequence[str] = vocab.SPECIAL_WORK_INDICATORS,
    common: Sequence[str] = vocab.COMMON_SERVICE_INDICATORS,
) -> Column:
    """``obra_ou_especial`` beats ``comum``; neither gives ``indeterminado``."""
    folded = fold(text)
    return (
        F.when(contains_any(folded, [fold_word(t) for t in special]), "obra_ou_especial")
        .when(contains_any(folded, [fold_word(t) for t in common]), "comum")
        .otherwise("indeterminado")
    )


def evidence_excerpts(
    text: Column,
    patterns: Sequence[str],
    head: int = 1200,
    window: int = 400,
    max_chars: int = 5000,
    flags: str = "(?i)",
) -> Column:
    """Opening of the text plus a window around the first hit of each pattern.

    Windows that overlap one already taken are skipped; nothing is added once the pieces
    exceed ``max_chars``, and the joined result is cut there.
    """
    total = F.length(text)

    def span(pattern: str) -> Column:
        hit = F.regexp_substr(text, F.lit(flags + pattern))
        start = F.regexp_instr(text, F.lit(flags + pattern)) - F.lit(1)
        lo = F.greatest(F.lit(0), start - F.lit(window))
        hi = F.least(total, start + F.length(hit) + F.lit(window))
        return F.when(hit.isNotNull(), F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))

    spans = F.filter(F.array(*[span(p) for p in patterns]), lambda s: s.isNotNull())
    first = F.substring(text, F.lit(1), F.lit(head))
    start = F.struct(
        F.array(F.struct(F.lit(0).alias("lo"), F.lit(head).alias("hi"))).alias("used"),
        F.array(first).alias("parts"),
        F.length(first).alias("size"),
        F.lit(False).alias("full"),
    )

    def step(acc: Column, s: Column) -> Column:
        clash = F.exists(acc["used"], lambda u: (s["lo"] < u["hi"]) & (s["hi"] > u["lo"]))
        piece = F.concat(F.lit("[...] "), F.substring(text, s["lo"] + F.lit(1), s["hi"] - s["lo"]))
        size = acc["size"] + F.length(piece)
        grown = F.struct(
            F.concat(acc["used"], F.array(s)).alias("used"),
            F.concat(acc["parts"], F.array(piece)).alias("parts"),
            size.alias("size"),
            (size > max_chars).alias("full"),
        )
        return F.when(acc["full"] | clash, acc).otherwise(grown)

    joined = F.aggregate(spans, start, step, lambda acc: F.array_join(acc["parts"], "\n"))
    return F.when(F.coalesce(total, F.lit(0)) == 0, "").otherwise(F.substring(joined, F.lit(1), F.lit(max_chars)))


def json_from_text(text: Column, schema: str) -> Column:
    """Parse the first brace block of free text; single-quoted JSON is accepted too."""
    block = F.regexp_extract(text, vocab.JSON_BLOCK_PATTERN, 0)
    return F.when(block != "", F.from_json(block, schema, {"allowSingleQuotes": "true"}))


def normalise_verdict(value: Column, domain: Sequence[str] = ("sim", "nao", "parcial")) -> Column:
    """Trimmed, lower case, ``não`` as ``nao``; anything outside ``domain`` is empty."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    v = F.when(v == "não", "nao").otherwise(v)
    return F.when(v.isin(list(domain)), v).otherwise("")


def money_br(value: Column) -> Column:
    """``R$ 1.234,50``; null and NaN give a dash."""
    shown = F.translate(F.format_number(value, 2), ",.", ".,")
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.concat(F.lit("R$ "), shown))


# Ordered suffix rules of the light stemmer: (pattern, replacement).
STEM_RULES = (
    (r"(oes|aes|aos)$", "ao"),
    (r"ais$", "al"),
    (r"eis$", "el"),
    (r"ois$", "ol"),
    (r"ns$", "m"),
    (r"(r|z)es$", "$1"),
    (r"([a-z]{3,})s$", "$1"),
    (r"([a-z]{3,})[ao]$", "$1"),
)


def stem(word: Column) -> Column:
    """Merge plural and gender variants of a folded word with a few ordered suffix rules."""
    for pattern, replacement in STEM_RULES:
        word = F.regexp_replace(word, pattern, replacement)
    return word
