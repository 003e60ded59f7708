"""String functions of discussion documents, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks automated and removed content.
BOT_AUTHORS = ("automoderator", "[deleted]", "reddit", "sub_doesnt_exist_bot")
BOT_MARKERS = ("i am a bot", "performed automatically", "beep boop", "thank you for your submission", "this action was performed", "^(i am a bot")
REMOVED = ("[deleted]", "[removed]")
# Rule texts that forbid or limit promotion.
POSTURE_HOSTILE = r"(?i)no (self.?)?promo|zero tolerance|no advertis|will be removed if.*promotional|no vendor|product mentions will be removed|no soliciting"
POSTURE_CAPPED = r"(?i)weekly (promo|thread)|self.?promotion (is )?(allowed|permitted).{0,40}(saturday|thread|once)|max \d+ mention|karma requirement|\d+ karma"


def strip_markup(c: Column) -> Column:
    """Without code fences, inline code and quoted lines."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```|`[^`]+`", " "), r"(?md)^>.*$", " ")


def normalise_text(text: str) -> str:
    """NFKC, case folded, possessives dropped, white space collapsed."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return re.sub(r"\s+", " ", re.sub(r"['’]s\b", "", folded))


def normalised(c: Column) -> Column:
    """Column form of :func:`normalise_text` (NFKC has no function in the JVM)."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normalise_text(t))

    return apply(c)


def normalised_ascii(c: Column) -> Column:
    """The same inside the JVM, for text whose letters are ASCII."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"['’]s\b", ""), r"\s+", " ")


def lowered(c: Column, source: Column | None = None) -> Column:
    """Lower case without NFKC or case folding (a sharp s stays one): possessives with an ASCII apostrophe dropped, ASCII white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"'s(?![A-Za-z0-9_])", ""), r"[\t\n\f\r ]+", " ")


#: Characters that NFKC leaves alone and whose case folding is lower case (but for the sharp s).
_SETTLED = r"À-ÖØ-öø-ÿ‘’“”–—А-яЁё\u4E00-\u9FFF"


def normalised_column(c: Column, source: Column | None = None) -> Column:
    """:func:`normalise_text` as an expression: in the JVM for texts of settled characters, by Python for the others only.

    ``source`` is a column whose characters include those of ``c``; it tells which way to go (``c`` itself if unset).
    """
    seen = c if source is None else source
    # The few characters beyond ASCII are looked at alone: a class of many ranges is slow.
    settled = (F.length(seen) == F.octet_length(seen)) | ~F.regexp_replace(seen, r"[\x00-\x7F]+", "").rlike(f"[^{_SETTLED}]")
    folded = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    inside = F.regexp_replace(F.regexp_replace(folded, r"(?U)['’]s\b", ""), r"[\s\x0B\x1C-\x1F]+", " ")
    return F.when(settled, inside).otherwise(normalised(F.when(~settled, c)))


def slugify(name: Column, domains: Column | None = None) -> Column:
    """A slug of the name's Latin letters and digits, else of the first domain that gives one; null if neither does."""
    def kebab(c: Column) -> Column:
        return F.nullif(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))

    spelled = F.replace(F.replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(" ")), F.lit("+"), F.lit(" plus "))
    out = kebab(spelled)
    if domains is None:
        return out
    labels = F.transform(F.split(F.coalesce(domains, F.lit("")), ";"), lambda x: kebab(F.split(F.lower(F.trim(x)), r"\.")[0]))
    return F.coalesce(out, F.get(F.filter(labels, lambda x: x.isNotNull()), F.lit(0)))


def decode_entities(c: Column) -> Column:
    """The six entity forms that bodies carry; the ampersand comes first, so double escapes decode."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, "&#39;|&#x27;", "'"), "(?i)&#x200B;", "")


def is_bot(author: Column, body: Column) -> Column:
    a, b = F.lower(F.trim(F.coalesce(author, F.lit("")))), F.lower(F.coalesce(body, F.lit("")))
    marked = F.lit(False)
    for m in BOT_MARKERS:
        marked = marked | b.contains(m)
    return a.isin(*BOT_AUTHORS) | a.endswith("bot") | marked


def is_removed(c: Column) -> Column:
    return c.isNull() | c.isin("", *REMOVED)


def post_body(title: Column, selftext: Column) -> Column:
    """Title, blank line, text; the title alone where the text is empty or removed; null where both are."""
    t, s = F.nullif(F.trim(title), F.lit("")), F.trim(selftext)
    s = F.when(~is_removed(s), s)
    return F.nullif(F.concat_ws("\n\n", t, s), F.lit(""))


def word_pattern(forms: list[str]) -> str:
    """One alternation of whole words, longest first."""
    ordered = sorted(set(forms), key=lambda f: (-len(f), f))
    return "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(f) for f in ordered) + ")(?![a-z0-9])"


def mark_target(body: Column, form: Column, offset: Column, width: int = 1200) -> Column:
    """A window of ``width`` characters around an offset, with the occurrence of the form that is nearest to it marked.

    Cut ends show as an ellipsis. The offset may be off by a few characters, as markup was taken out
    when it was found; a form that does not occur in the window is named in a line above it.
    """
    begin = F.greatest(offset - width // 2, F.lit(0))
    window = F.substring(body, begin + 1, F.least(F.lit(width), offset - begin + width // 2))
    places = F.transform(F.split(F.lower(window), F.concat(F.lit("\\Q"), F.lower(form), F.lit("\\E")), -1), F.length)
    starts = F.transform(F.slice(places, 1, F.size(places) - 1), lambda _, i: F.aggregate(F.slice(places, 1, i + 1), F.lit(0), lambda n, x: n + x) + i * F.length(form))
    nearest = F.array_min(F.transform(starts, lambda at: F.struct(F.abs(at + begin - offset).alias("off"), at.alias("at"))))["at"]
    marked = F.concat(F.substring(window, F.lit(1), nearest), F.lit("<<TARGET:"), F.substring(window, nearest + 1, F.length(form)), F.lit(">>"), F.substring(window, nearest + F.length(form) + 1, F.length(window)))
    named = F.concat(F.lit("[target: "), form, F.lit("]\n"), window)
    cut = F.when(begin + F.length(window) < F.length(body), "…").otherwise("")
    return F.concat(F.when(begin > 0, "…").otherwise(""), F.coalesce(marked, named), cut)


def name_tokens(c: Column) -> Column:
    """Words of a compound name: at camel case, digits and separators, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbouring words written together."""
    n = F.size(tokens)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def stems(word: Column) -> Column:
    """The word and what it may be a plural of."""
    n = F.length(word)
    cut = lambda end, k, tail="": F.when(word.endswith(end) & (n > k + 1), F.concat(F.substring(word, F.lit(1), n - k), F.lit(tail)))
    return F.array_distinct(F.array_compact(F.array(word, cut("s", 1), cut("es", 2), cut("ies", 3, "y"))))


def registrable_label(domain: Column) -> Column:
    """The label before the public suffix, which may have two parts; null without a suffix."""
    parts = F.filter(F.split(F.lower(F.trim(domain)), r"\."), lambda p: p != "")
    two = (F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-2)).isin("co", "com", "org", "net", "ac")
    return F.when(F.size(parts) >= 2, F.when(two, F.try_element_at(parts, F.lit(-3))).otherwise(F.try_element_at(parts, F.lit(-2))))


def owns_domain(domain: Column, slug: Column) -> Column:
    """Whether a domain's label names the brand: a word of its slug, all of it, or a long word inside the label."""
    label = registrable_label(domain)
    words = F.filter(F.split(F.lower(slug), "[^a-z0-9]+"), lambda w: w != "")
    named = F.array_contains(words, label) | (label == F.replace(F.lower(slug), F.lit("-"), F.lit(""))) | F.exists(words, lambda w: (F.length(w) >= 5) & label.contains(w))
    return F.coalesce(named, F.lit(False))


def community_name(c: Column) -> Column:
    """A community's bare name, or null where the text is none."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "^/+|/+$", ""), "(?i)^(r/|/r/)", "")
    s = F.regexp_replace(F.trim(s), r"[.,;:!?)]+$", "")
    return F.when(s.rlike("^[A-Za-z0-9_]{2,50}$") & ~F.lower(s).startswith("u_"), s)


def posture(rules: Column) -> Column:
    return F.when(rules.rlike(POSTURE_HOSTILE), "hostile").when(rules.rlike(POSTURE_CAPPED), "capped").otherwise("permissive")


def split_list(c: Column) -> Column:
    """Parts of a semicolon list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def fit_title(c: Column, fallback: Column, most: int = 60) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(fallback)


def clean_truncated(c: Column, most: int) -> Column:
    """Without NUL characters, cut to a length."""
    return F.left(F.replace(c, F.char(F.lit(0)), F.lit("")), F.lit(most))


def first_json(c: Column) -> Column:
    """The text from the first opening to the last closing brace (fences and chatter around it are dropped)."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def batch_id(ids: Column) -> Column:
    """SHA-256 of a list's sorted members."""
    return F.sha2(F.array_join(F.sort_array(ids), "").cast("binary"), 256)


def json_root_text(c: Column) -> Column:
    """The text of a JSON value: a string without its quotes, a number or a boolean as it stands; JSON null is null (the string "null" is not)."""
    return F.when(F.trim(c) != "null", F.get_json_object(c, "$"))
