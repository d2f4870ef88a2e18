"""Keys, names, clocks and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A message is of the first class that has a part of it. Throttling comes first, as its
#: message also asks to sign in.
MARKERS = (
    ("throttled", ("not a bot", "needs to be reloaded", "too many requests", "http error 429", "rate-limited", "sabr-only", "only images are available")),
    ("gone", ("video unavailable", "private video", "has been removed", "has been terminated", "no longer available", "removed for violating", "does not exist")),
    ("blocked", ("please sign in", "confirm your age", "age-restricted", "members-only", "join this channel", "available to this channel's members", "inappropriate for some users")),
)


def track_key(work: Column, version: Column) -> Column:
    return F.concat_ws("_", work.cast("string"), version.cast("string"))


def work_of(key: Column) -> Column:
    return F.split(key, "_")[0].cast("bigint")


def version_of(key: Column) -> Column:
    return F.split(key, "_")[1].cast("bigint")


def track_of_window(window_id: Column) -> Column:
    return F.substring_index(window_id, "_", 2)


def video_url(video: Column, at: Column | None = None, base: str = "https://www.youtube.com/watch?v=") -> Column:
    url = F.concat(F.lit(base), video)
    return url if at is None else F.concat(url, F.lit("&t="), F.floor(at).cast("string"))


def stem(name: Column) -> Column:
    """A file name without folders and its last suffix."""
    return F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1)


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"[^/](\.[^./]*)$", 1)


def milliseconds(start: Column) -> Column:
    """Seconds as whole milliseconds, half to even."""
    return F.bround(start * 1000).cast("bigint")


def window_id(key: Column, start: Column) -> Column:
    return F.concat(key, F.lit("_"), F.lpad(milliseconds(start).cast("string"), 8, "0"))


def pair_stem(work: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("_", work.cast("string"), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def outcome_of(error: Column, warnings: Column | None = None, markers=MARKERS) -> Column:
    """The class of a failure; the order of the lists decides, and warnings are searched too."""
    text = F.lower(F.concat_ws(" ", error) if warnings is None else F.concat_ws(" ", error, warnings))
    out = None
    for name, parts in markers:
        hit = text.contains(parts[0])
        for p in parts[1:]:
            hit = hit | text.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("failed")


def human_bytes(n: Column, largest: str = "TiB") -> Column:
    """Bytes to one decimal in the largest unit of 1024, up to `largest`, that leaves at least one."""
    n = n.cast("double")
    out = F.when(n < 1024, F.concat(F.floor(n).cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        shown = F.concat(F.format_string("%.1f", F.floor(n / 1024.0**k * 10 + 0.5) / 10), F.lit(f" {unit}"))
        if unit == largest:
            return out.otherwise(shown)
        out = out.when(n < 1024.0 ** (k + 1), shown)
    raise ValueError(f"no unit {largest}")


def clock(seconds: Column) -> Column:
    """Seconds as m:ss, floored."""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def shortened(text: Column, most: int) -> Column:
    """One line of a message: no colour codes, no leading `ERROR: `, cut with an ellipsis."""
    text = F.trim(F.replace(F.regexp_replace(text, "\\x1b\\[[0-9;]*m", ""), F.lit("\n"), F.lit(" ")))
    text = F.regexp_replace(text, "^ERROR: ", "")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def number_or(text: Column, otherwise: float | None = None) -> Column:
    value = text.try_cast("double")
    return value if otherwise is None else F.coalesce(value, F.lit(float(otherwise)))


def run_stamp(name: Column) -> Column:
    """The start time in a run folder's name, yyyyMMdd-HHmmss, or null."""
    part = F.regexp_extract(name, r"(\d{8}-\d{6})", 1)
    return F.when(part != "", F.to_timestamp(part, "yyyyMMdd-HHmmss"))


#: Codecs that a chain may name, and the sample rates that opus takes.
CODECS = ("mp3", "opus", "aac")
OPUS_RATES = (48000, 24000, 16000, 12000, 8000)


def codec_chain(spec: Column) -> Column:
    """Stages of `codec:bitrate[:sample_rate[:channels]]+...` as an array of structs; null, empty and `none` have none.

    Defaults are 44,100 Hz (48,000 for opus) and 2 channels; spaces around a stage do not count. A stage is
    `valid` if it has two to four fields, a known codec, whole numbers and, for opus, one of its rates.
    """

    def one(part: Column) -> Column:
        f = F.split(F.trim(part), ":", -1)
        codec = F.get(f, F.lit(0))
        rate = F.when(F.size(f) > 2, F.get(f, F.lit(2)).try_cast("int")).when(codec == "opus", F.lit(48000)).otherwise(F.lit(44100))
        channels = F.when(F.size(f) > 3, F.get(f, F.lit(3)).try_cast("int")).otherwise(F.lit(2))
        known = F.size(f).between(2, 4) & codec.isin(*CODECS) & rate.isNotNull() & channels.isNotNull()
        valid = known & ((codec != "opus") | rate.isin(*OPUS_RATES))
        return F.struct(codec.alias("codec"), F.get(f, F.lit(1)).alias("bitrate"), rate.alias("sample_rate"), channels.alias("channels"), F.coalesce(valid, F.lit(False)).alias("valid"))

    none = F.coalesce(F.lower(F.trim(spec)), F.lit("")).isin("", "none")
    stages = F.transform(F.split(spec, "\\+", -1), one)
    return F.when(none, F.filter(F.array(one(F.lit(""))), lambda s: s["valid"])).otherwise(stages)


def codec_chain_ok(chain: Column) -> Column:
    return F.forall(chain, lambda s: s["valid"])


def _stages(chain: Column, between: str) -> Column:
    return F.transform(chain, lambda s: F.concat_ws(between, s["codec"], s["bitrate"], s["sample_rate"].cast("string"), s["channels"].cast("string")))


def codec_name(chain: Column) -> Column:
    """The canonical spelling with all four fields of each stage; null where there is no stage."""
    return F.when(F.size(chain) > 0, F.array_join(_stages(chain, ":"), "+"))


def codec_slug(chain: Column) -> Column:
    """The same for folder names, so that no two chains share one; empty where there is no stage."""
    return F.array_join(_stages(chain, "-"), "_")


def interval_label(low: Column, high: Column, above: str = "real gain", below: str = "real loss", within: str = "within noise") -> Column:
    return F.when(low > 0, above).when(high < 0, below).otherwise(within)
