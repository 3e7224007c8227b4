"""Text expressions on columns: tokens, stems, similarities, cutting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as part of a token, and as white space.
TOKEN = r"[\p{L}\p{N}_À-ỹ]+"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: Words without content, when questions are compared with passages.
RETRIEVAL_STOPS = """a an and are as at by can could did do does finding findings find finds for from give how in is it key main me
of on or overall outcome outcomes paper please provide related retrieval result results show studied study tell terms the this to what
where why with cac các cua của gi gì goi gọi khac khác la là nao nào nguoi người nhung những ten tên cho dau den đâu đến o ở toi tới trong
tu từ ve về""".split()
#: The reranker's words without content.
RERANK_STOPS = """a an and are as at by does do for from how in is it key main of on or overall paper study the this to what where why with
cho cua của dau den đâu đến la là o ở toi tới trong tu từ ve về""".split()
#: Words without content when support is estimated.
SUPPORT_STOPS = """a an and are as by can could did do does document for from how in information is main of on or paper provided question
report study the this to what when where whether why with""".split()

#: Words without content when a sentence is compared with its sources.
CITATION_STOPS = "a an and are as at by for from in is it of on or that the this to with according provided document paper".split()


def plain_tokens(text: str) -> list[str]:
    """What tokenize gives for a constant, in Python: rules of profiles are tokenised once."""
    out = []
    for t in re.findall(r"[^\W]+", text.lower()):
        if re.fullmatch("[a-z]+", t):
            if len(t) > 4 and t.endswith("ies"):
                t = t[:-3] + "y"
            elif len(t) > 5 and t.endswith(("ches", "shes", "sses", "xes", "zes")):
                t = t[:-2]
            elif len(t) > 4 and t.endswith("s") and not t.endswith(("ss", "us", "sis")):
                t = t[:-1]
        out.append(t)
    return out


def words(text: Column) -> Column:
    """Tokens as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def stem(token: Column) -> Column:
    """Lower case; plural endings of plain ASCII words go, by the first rule that fits."""
    t = F.lower(token)
    n = F.length(t)
    cut = lambda k, end="": F.concat(F.substring(t, F.lit(1), n - k), F.lit(end))
    plain = (
        F.when((n > 4) & t.endswith("ies"), cut(3, "y"))
        .when((n > 5) & t.rlike("(ches|shes|sses|xes|zes)$"), cut(2))
        .when((n > 4) & t.endswith("s") & ~t.rlike("(ss|us|sis)$"), cut(1))
        .otherwise(t)
    )
    return F.when(t.rlike("^[a-z]+$"), plain).otherwise(t)


def tokenize(text: Column) -> Column:
    return F.filter(F.transform(words(text), stem), lambda t: t != "")


def content_terms(text: Column, stops: list[str], keep_ai: bool = False) -> Column:
    listed = F.array(*map(F.lit, stops))
    long = lambda t: (F.length(t) > 2) | (t == "ai") if keep_ai else F.length(t) > 2
    return F.filter(tokenize(text), lambda t: long(t) & ~F.array_contains(listed, t))


def jaccard(left: Column, right: Column) -> Column:
    """Shared tokens over all tokens of two arrays; 0 if either is empty."""
    some = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(some, F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def collapse(text: Column) -> Column:
    """Runs of blanks to one space, three and more line breaks to two."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0b]+", " "), r"\n{3,}", "\n\n")


def punctuation(text: Column) -> Column:
    """No white space before marks, one space after them, none between a number and %."""
    out = F.regexp_replace(text, f"{SPACE}+([,.!?;:%])", "$1")
    out = F.regexp_replace(out, rf"([,.!?;:])(?=[^\p{{IsWhite_Space}}\x1c-\x1f])", "$1 ")
    return F.regexp_replace(out, rf"(\p{{Nd}}){SPACE}+%", "$1%")


def shorten(text: Column, limit: int) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def keyword_form(text: Column) -> Column:
    """Lower case, quarters spelled out, hyphens and underscores as spaces."""
    out = F.lower(text)
    for k in "1234":
        out = F.replace(out, F.lit(f"q{k}"), F.lit(f" quarter {k} "))
    return F.translate(out, "-_", "  ")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def trim_parent(text: Column, limit: int = 3000) -> Column:
    """At most limit characters, cut back to the last space."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(cut, " [^ ]*$", ""))


def windows(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """Fixed windows, each stripped, until one reaches the end."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(F.when(n > 0, cut).otherwise(F.array().cast("array<string>")), lambda x: x != "")
