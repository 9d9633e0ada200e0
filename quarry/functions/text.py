"""Column functions for text: tokens, the light analysis chain, cleaning, passages, field choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The basic stop words and suffix rules of the analysis chain.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "this", "but", "they", "have", "had", "what", "said", "each", "which", "their", "time", "if",
)
SUFFIXES = (("ing", 3), ("ed", 2), ("s", 1))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores that are two or more of a to z, in order, with repeats."""
    whole = r"(?<![\p{L}\p{N}_])[a-z]{2,}+(?![\p{L}\p{N}_])"  # one pattern with borders, so that no token is looked at twice
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(whole), F.lit(0))


def stem(token: Column) -> Column:
    """The first suffix rule that fits."""
    out = token
    for suffix, n in reversed(SUFFIXES):
        out = F.when(token.endswith(suffix), F.substring(token, F.lit(1), F.length(token) - n)).otherwise(out)
    return out


def tokenize(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token), one row for each token."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def analyze(df: DataFrame, key: str, text: str, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(key, pos, form, stem): tokens that are not stop words, with their stems; tokens with an empty stem are dropped."""
    found = tokenize(df, key, text).where(~F.col("token").isin(*stopwords))
    return found.select(key, "pos", F.col("token").alias("form"), stem(F.col("token")).alias("stem")).where("stem != ''")


def _head(text: Column, most: int | None) -> Column:
    """The first characters, or the whole text."""
    return text if most is None else F.substring(text, 1, most)


def doc_text(raw: Column, title: Column | None = None, body: Column | None = None, max_chars: int | None = 50_000) -> Column:
    """Text of a document: the contents if there are any, else title and body joined by a space; null if nothing is left."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    joined = F.concat_ws(" ", *(blank(c) for c in (title, body) if c is not None))
    return F.nullif(_head(F.coalesce(blank(raw), F.trim(joined)), max_chars), F.lit(""))


def query_text(text: Column, title: Column, description: Column) -> Column:
    """The text if there is one, else title and description, else the title."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(text), F.nullif(F.concat_ws(" ", blank(title), blank(description)), F.lit("")))


def clean_query(text: Column) -> Column:
    """Letters, digits, underscores, hyphens and single spaces; `empty query` if nothing is left."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s\-]", " "), r"\s+", " "))
    return F.when(kept == "", "empty query").otherwise(kept)


# Latin letters with marks, and the letter that decomposition leaves of each.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def clean_text(text: Column, mode: str = "ascii", max_chars: int | None = None) -> Column:
    """The first max_chars characters (100,000 and 50,000 are usual), if given. mode ascii: marks removed, printable ASCII only, single spaces, under 3 characters empty;
    mode control: control characters become spaces, single spaces."""
    if mode == "ascii":
        plain = F.regexp_replace(F.translate(_head(F.coalesce(text, F.lit("")), max_chars), MARKED, PLAIN), r"[^\x20-\x7E\s]", "")
        out = F.trim(F.regexp_replace(plain, r"\s+", " "))
        return F.when(F.length(out) < 3, "").otherwise(out)
    spaced = F.regexp_replace(_head(F.coalesce(text, F.lit("")), max_chars), r"[\x00-\x1F\x7F-\x{9F}]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def preprocess_document(text: Column, max_len: int | None = 5_000, min_len: int = 10) -> Column:
    """Cleaned text of at most max_len characters, if given; empty if it is shorter than min_len."""
    cut = _head(clean_text(text, "ascii"), max_len)
    return F.when(F.length(cut) < min_len, "").otherwise(cut)


def passages(text: Column, size: int = 10, stride: int = 5, max_chars: int | None = 10_000) -> Column:
    """Windows of `size` sentences every `stride`, the last one that which reaches the end; array of strings."""
    head = _head(F.coalesce(text, F.lit("")), max_chars)
    units = F.filter(F.transform(F.split(head, r"\.[\s]+|\n"), lambda s: F.trim(s)), lambda s: s != "")
    n = F.size(units)
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride).cast("int"))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(units, i * stride + 1, size), ". "))
    )


def band(score: Column, kind: str) -> Column:
    """Very High to Very Low by the thresholds of the kind: rm3, semantic or combined."""
    # The ladders of thresholds.
    ladders = {"rm3": (0.1, 0.05, 0.02, 0.01), "semantic": (0.8, 0.6, 0.4, 0.2), "combined": (0.15, 0.08, 0.04, 0.02)}
    out = F.lit("Very Low")
    for least, name in reversed(tuple(zip(ladders[kind], ("Very High", "High", "Medium", "Low"), strict=True))):
        out = F.when(score >= least, name).otherwise(out)
    return out
