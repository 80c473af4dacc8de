"""Settings, the stage rules of each format, and what makes a file have none."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("png", "jpeg", "gif", "webp", "svg", "heic", "jxl")
EFFORTS = ("fast", "standard", "high", "max")


@dataclass(frozen=True)
class Settings:
    """One snapshot for all files of a run."""

    lossy: bool = False
    quality: int = 85
    effort: str = "standard"
    level: str = "private"
    output: str = "suffix"
    suffix: str = "-small"
    folder: str | None = None
    include_unchanged: bool = True
    disabled: frozenset[str] = field(default_factory=frozenset)
    chooser: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.quality <= 100:
            raise ValueError("quality is 1 to 100")
        if self.effort not in EFFORTS or self.level not in ("keep", "private", "copyright", "none") or self.output not in ("replace", "suffix", "folder"):
            raise ValueError("unknown effort, level or output")
        if self.output == "suffix" and (not self.suffix.strip() or "/" in self.suffix):
            raise ValueError("a suffix is not blank and has no slash")
        if self.output == "folder" and not self.folder:
            raise ValueError("no folder given")
        if self.disabled - set(FORMATS):
            raise ValueError("unknown format")


@dataclass(frozen=True)
class Candidate:
    name: str
    lossy: bool = False
    hidden_colour: bool = False
    minimum_gain: float = 0.0
    judged_finished: bool = False
    required: bool = False


# What each effort asks of the compressors, as their options; the run with Zopfli is for still images only.
PNG_OPTIONS = {"fast": "-o 2", "standard": "-o 2 -f 0-9 --zc 13", "high": "-o 2 -f 0-9 --zc 14", "max": "-o 2 -f 0-9 --zc 14"}
PNG_ZOPFLI = "-o max -f 0-10 --fast --zopfli --zi 60 --ziwi 10"
WEBP_LEVELS = {"fast": (7,), "standard": (9, 7), "high": (9, 7), "max": (9, 7)}
JXL_EFFORTS = {"fast": [7], "standard": [7], "high": [9, 7], "max": [9, 7]}
PALETTE_GAIN, HEIC_GAIN = 0.05, 0.01


def stages(fmt: str, facts: dict, s: Settings) -> list[list[Candidate]]:
    """Stages in order, each with candidates that compete. facts: is_animated, jpeg_quality, readable, is_lossless_webp, has_webp_metadata, is_utf16, is_uncheckable, bits, from_jpeg."""
    metadata = Candidate("metadata", required=s.level != "keep")
    lossy = s.lossy and not s.chooser
    plan: list[list[Candidate]] = []
    if fmt == "png":
        slow = s.effort == "max" and not facts.get("is_animated")
        runs = [Candidate(f"oxipng {o}") for o in ([PNG_ZOPFLI] if slow else []) + [PNG_OPTIONS[s.effort]]]
        plan = [[metadata], runs]
        if lossy and not facts.get("is_animated"):
            plan += [[Candidate("quantizr", lossy=True, minimum_gain=PALETTE_GAIN, judged_finished=True)], runs]
    elif fmt == "jpeg":
        if lossy and facts.get("readable", True) and (facts.get("jpeg_quality") or 100) > s.quality:
            plan.append([Candidate("jpegli", lossy=True)])
        plan += [[metadata], [Candidate("jpeg-scan")]]
        if s.chooser:
            plan += [[Candidate("chosen jpegli", lossy=True)], [Candidate("jpeg-scan")]]
    elif fmt == "webp":
        if facts.get("has_webp_metadata"):
            plan.append([metadata])
        if facts.get("is_lossless_webp") and not facts.get("is_animated"):
            plan.append([Candidate(f"cwebp -z {level}") for level in WEBP_LEVELS[s.effort]])
    elif fmt == "svg":
        if facts.get("is_utf16"):
            plan.append([Candidate("utf-8", required=True)])
        if not facts.get("is_uncheckable"):
            plan.append([Candidate("oxvg"), Candidate("oxvg ids kept")])
    elif fmt == "heic":
        # an encoding that follows writes only what the level keeps, so it is the filter's second chance
        again = lossy and facts.get("bits", 8) <= 8
        if s.level != "keep" and not facts.get("is_animated"):
            plan.append([Candidate("metadata", required=not again)])
        if again:
            plan.append([Candidate("heic", lossy=True, minimum_gain=HEIC_GAIN)])
    elif fmt == "jxl" and facts.get("from_jpeg"):
        plan = [[Candidate("jxl-recompress", required=s.level != "keep")]]
    return plan


def rules(spark: SparkSession, s: Settings) -> DataFrame:
    """The rules as rows (format, variant, stage, cand, name, lossy, minimum_gain, required, judged_finished), for a join with facts. Bounded."""
    variants = {
        "png": {"still": {}, "animated": {"is_animated": True}},
        "jpeg": {"above": {"jpeg_quality": None}, "below": {"jpeg_quality": 1}, "unreadable": {"readable": False}},
        "webp": {f"{'lossless' if a else 'lossy'}{' metadata' if b else ''}{' animated' if c else ''}": {"is_lossless_webp": a, "has_webp_metadata": b, "is_animated": c} for a in (0, 1) for b in (0, 1) for c in (0, 1)},
        "svg": {f"{'utf16' if a else 'utf8'}{' uncheckable' if b else ''}": {"is_utf16": a, "is_uncheckable": b} for a in (0, 1) for b in (0, 1)},
        "heic": {f"{'animated' if a else 'still'}{' deep' if b > 8 else ''}": {"is_animated": a, "bits": b} for a in (False, True) for b in (8, 10)},
        "jxl": {"from jpeg": {"from_jpeg": True}, "own": {}},
        "gif": {"any": {}},
    }
    rows = [
        (fmt, variant, i, k, c.name, c.lossy, c.minimum_gain, c.required, c.judged_finished)
        for fmt, own in variants.items()
        for variant, facts in own.items()
        for i, group in enumerate(stages(fmt, facts, s))
        for k, c in enumerate(group)
    ]
    return spark.createDataFrame(rows, "format string, variant string, stage int, cand int, name string, lossy boolean, minimum_gain double, required boolean, judged_finished boolean")


def variant(fmt: Column, facts: dict[str, Column], s: Settings) -> Column:
    """Which variant of a format's rules a row of facts has."""
    get = lambda k, d=False: F.coalesce(facts[k], F.lit(d)) if k in facts else F.lit(d)
    webp = F.concat(F.when(get("is_lossless_webp"), "lossless").otherwise("lossy"), F.when(get("has_webp_metadata"), " metadata").otherwise(""), F.when(get("is_animated"), " animated").otherwise(""))
    svg = F.concat(F.when(get("is_utf16"), "utf16").otherwise("utf8"), F.when(get("is_uncheckable"), " uncheckable").otherwise(""))
    return (
        F.when(fmt == "png", F.when(get("is_animated"), "animated").otherwise("still"))
        .when(fmt == "jpeg", F.when(~get("readable", True), "unreadable").when(get("jpeg_quality", 100) > s.quality, "above").otherwise("below"))
        .when(fmt == "webp", webp)
        .when(fmt == "svg", svg)
        .when(fmt == "heic", F.concat(F.when(get("is_animated"), "animated").otherwise("still"), F.when(get("bits", 8) > 8, " deep").otherwise("")))
        .when(fmt == "jxl", F.when(get("from_jpeg"), "from jpeg").otherwise("own"))
        .otherwise("any")
    )


def candidates(facts: DataFrame, s: Settings, key: str = "file_id") -> DataFrame:
    """Rows of candidates for rows of facts (key, format, …): a broadcast join with the rules."""
    names = ["is_animated", "jpeg_quality", "readable", "is_lossless_webp", "has_webp_metadata", "is_utf16", "is_uncheckable", "bits", "from_jpeg"]
    own = {n: F.col(n) for n in names if n in facts.columns}
    keyed = facts.withColumn("variant", variant(F.col("format"), own, s))
    return keyed.join(F.broadcast(rules(facts.sparkSession, s)), ["format", "variant"]).drop("variant")


def reason_for_no_stages(fmt: Column, is_animated: Column, lossy: bool) -> Column:
    """Kind of the `notSupported` reason of a file whose rules give no stage."""
    return (
        F.when((fmt == "webp") & is_animated, "animatedWebP")
        .when(fmt == "webp", "lossyWebP")
        .when(fmt == "gif", "gif")
        .when(fmt == "heic", "hdrHEIC" if lossy else "heicWithoutLoss")
        .when(fmt == "jxl", "jxlNotFromJPEG")
        .otherwise("nothingToOptimize")
    )


# Conversion between JPEG and JPEG XL.


def direction(fmt: Column, target: str) -> Column:
    return F.when((fmt == "jpeg") & F.lit(target == "jxl"), "toJXL").when((fmt == "jxl") & F.lit(target == "jpeg"), "toJPEG")


def jxl_obstacle(has_video: Column, images: Column, other_bytes: Column) -> Column:
    return F.when(has_video, "video").when(images > 1, "moreImages").when(other_bytes > 0, "otherData")


def obstacle_to_jpeg(from_jpeg: Column, needs_brotli: Column) -> Column:
    return F.when(~from_jpeg, "notFromJPEG").when(needs_brotli > 0, "compressedBoxes")
