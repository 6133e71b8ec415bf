"""Times and rates in manifests and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_duration_seconds(text: Column) -> Column:
    """Seconds of P[nD]T[nH][nM][nS]; null for anything else."""
    form = r"^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    total = sum((F.coalesce(F.regexp_extract(text, form, i).try_cast("double"), F.lit(0.0)) * w for i, w in ((1, 86400), (2, 3600), (3, 60), (4, 1))), F.lit(0.0))
    return F.when(text.rlike(form), total)


def frame_rate(text: Column) -> Column:
    """Frames a second of a number or a fraction; 0 if it is none."""
    first, bottom = F.regexp_extract(text, r"^\s*([\d.]+)", 1), F.regexp_extract(text, r"/\s*([\d.]+)\s*$", 1)
    top = F.when(first != "", first.try_cast("double"))  # the failed cast of an empty text costs an exception
    return F.coalesce(F.when(bottom == "", top).otherwise(F.try_divide(top, bottom.try_cast("double"))), F.lit(0.0))


#: The forms of a stamp, without fraction and zone.
FORMS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd MMM yyyy HH:mm:ss",
)
IST_S = 19800


def source_timestamp(text: Column) -> Column:
    """Epoch seconds (double) of a stamp in one of the forms; null for anything else.

    A zone is a word (IST, UTC, GMT), Z, or an offset after the time; without one the stamp is in the session's zone. A
    leading day's name and a fraction of the second may stand there.
    """
    text = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[A-Za-z]{3}, ", "")
    word = F.upper(F.regexp_extract(text, r"(?i)(?:\s(IST|UTC|GMT)|(?<=\d)Z)$", 1))
    body = F.regexp_replace(text, r"(?i)(?:\s+(?:IST|UTC|GMT)|(?<=\d)Z)$", "")
    offset = r"(?<=:\d\d|\.\d{1,9})([+-])(\d\d):?(\d\d)$"
    hours, minutes = (F.regexp_extract(body, offset, i).try_cast("int") for i in (2, 3))
    ahead = F.coalesce(F.when(F.regexp_extract(body, offset, 1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60), F.lit(0))
    body = F.regexp_replace(body, offset, "")
    fraction = F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract(body, r":\d\d\.(\d+)$", 1), F.lit(""))).try_cast("double"), F.lit(0.0))
    body = F.regexp_replace(body, r"(?<=:\d\d)\.\d+$", "")
    stamp = F.coalesce(*(F.try_to_timestamp(body, F.lit(f)) for f in FORMS))
    return F.unix_timestamp(stamp) - F.when(word == "IST", IST_S).otherwise(ahead) + fraction


def generated_timestamp(text: Column) -> Column:
    """Epoch seconds of the first stamp with a time in the first 80 lines that say when the text was generated or updated; else null.

    Every date of a line is tried in turn: its stamp is the longest run of up to three words from there that is one.
    """
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), 1, 80)
    said = F.filter(lines, lambda x: x.rlike(r"(?i)\b(?:generated|updated)\b"))
    first = lambda values: F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))

    def stamp(start: Column) -> Column:
        words = F.split(start, r"\s+")
        runs = [F.regexp_replace(F.array_join(F.slice(words, 1, n), " "), r"[,.;)\]]+$", "") for n in (3, 2, 1)]
        return F.coalesce(*(F.when(run.contains(":"), source_timestamp(run)) for run in runs))

    starts = lambda line: F.regexp_extract_all(line, F.lit(r"(?<!\d)(?=(\d{2,4}[-/]\d\d[-/]\d{2,4}\S*(?:\s+\S+){0,2}))"), F.lit(1))
    return first(F.transform(said, lambda line: first(F.transform(starts(line), stamp))))
