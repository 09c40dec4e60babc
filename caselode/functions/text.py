"""Text columns: stripping, joining, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Chinese, Japanese and Korean characters, with the Japanese marks of length and repetition.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー々]"
#: Quick to test: whatever these scripts hold lies here.
FAR = r"[^\x00-\x{10FF}]"
RUN = rf"{UNSPACED}+|[\p{{L}}\p{{N}}&&[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}ー々]]+"


def strip(c: Column | str) -> Column:
    """Drop white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column | str) -> Column:
    return F.lower(strip(c))


def filled(items: Column) -> Column:
    """Stripped items that aren't blank or null."""
    return F.filter(F.transform(items, strip), lambda x: F.coalesce(x != "", F.lit(False)))


def joined(items: Column, separator: str, empty: str = "None") -> Column:
    kept = filled(items)
    return F.when(F.size(kept) > 0, F.array_join(kept, separator)).otherwise(F.lit(empty))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def _pairs(w: Column) -> Column:
    return F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))


def terms(c: Column | str) -> Column:
    """Words, with neighbouring character pairs in place of runs of a script without spaces between words."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(RUN), F.lit(0))
    # Without such a script the runs are the words; classes of scripts are slow, so that a range is asked first.
    return F.when(~F.rlike(c, F.lit(FAR)), words(c)).otherwise(F.flatten(F.transform(runs, lambda w: F.when(w.rlike(f"^{UNSPACED}"), _pairs(w)).otherwise(F.array(w)))))


def bigrams(c: Column | str) -> Column:
    """Neighbouring character pairs of letter and digit runs; single characters stay."""
    return F.flatten(F.transform(words(c), _pairs))


def lenient_int(c: Column | str) -> Column:
    """Blank and "none" are null; else the integer."""
    s = normalize(c)
    return F.when(s.isin("", "none"), None).otherwise(strip(c).try_cast("bigint"))


def json_object(c: Column | str) -> Column:
    """From the first brace to the last; unchanged where there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.col(c) if isinstance(c, str) else c)


def divide(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))
