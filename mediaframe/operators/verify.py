"""Whether a result is the same picture: an ordered verifier over the facts of a pair, and the operators that find these facts.

A pair is one row. Facts come as columns, so every rule is an expression; the first that fails names the reason. Facts
with several rows a file (auxiliary images, images of a file, maker note tags) are aggregates and equi-joins by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import policy
from .compare import mean_difference

# What a verifier says.
SIZE, TURNED, RESOLUTION, LOST = "different dimensions", "orientation lost", "resolution changed", "animation or second image lost"
PROFILE, BRIGHTNESS, UNREADABLE, DAMAGED = "color profile lost", "HDR brightness changed", "unreadable", "the decoder reports damaged data"
TIMING, PIXELS, TEXT, LOOKS = "animation timing changed", "pixels changed", "text changed", "looks different"

# Messages of the reasons for leaving a file as it is; %s stands for the detail.
MESSAGES = {
    "empty": "Empty file",
    "notAnImage": "Not a supported image",
    "turnedOff": "%s is turned off in Settings",
    "readOnly": "The file or its destination folder is read-only",
    "damaged": "The file is damaged: %s",
    "contentCredentials": "Has Content Credentials (C2PA)",
    "appleCgBI": "Apple’s iPhone PNG variant (CgBI), which only Apple’s tools can read",
    "motionPhotoVideo": "Motion photo whose video can’t be located safely",
    "unreadableImages": "Holds images that can’t be read safely",
    "uncheckable": "%s – it can’t be checked safely",
    "notSupported": "%s",
    "metadataNotFilterable": "The metadata couldn’t be filtered safely: %s",
    "resultRejected": "Result rejected: %s",
    "alreadyOptimal": "Already optimal",
    "changedMeanwhile": "The file changed in the meantime",
    "inconvertible": "%s",
}
DAMAGED_SOMEHOW = "The file is damaged or incomplete"


def message(reason: Column, detail: Column) -> Column:
    """English message of a reason, with its detail where it has one."""
    table = F.create_map(*[F.lit(x) for k, v in MESSAGES.items() for x in (k, v)])
    text = F.element_at(table, reason)
    whole = F.when(F.contains(text, F.lit("%s")), F.concat(F.substring_index(text, "%s", 1), F.coalesce(detail, F.lit("")), F.substring_index(text, "%s", -1))).otherwise(text)
    return F.when((reason == "damaged") & detail.isNull(), DAMAGED_SOMEHOW).otherwise(whole)


def resolution(x: Column, y: Column) -> Column:
    """Dots per inch by which a file is shown, 72 without."""
    return F.array(F.coalesce(x, F.lit(72.0)), F.coalesce(y, F.lit(72.0)))


def browser_size(width: Column, height: Column, x: Column, y: Column, unit: Column, told_width: Column, told_height: Column) -> Column:
    """Size at which browsers show a JPEG: what its EXIF tells, where resolution in inches and pixel size agree with it at 72 dots per inch."""
    told = (x > 0) & (y > 0) & (F.coalesce(unit, F.lit(2)) == 2) & (told_width > 0) & (told_height > 0)
    fits = (width * 72 / x == told_width) & (height * 72 / y == told_height)
    return F.when(told & fits, F.array(told_width, told_height)).otherwise(F.array(width, height))


def first_failing(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule whose condition holds; null if none does. A condition without a value does not hold."""
    out = F.lit(None).cast("string")
    for broken, said in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), said if isinstance(said, Column) else F.lit(said)).otherwise(out)
    return out


def verdict(pairs: DataFrame) -> DataFrame:
    """pairs with `rejected`, the reason why a result is not the same picture (null: it is), and `hidden_kept`, false if colours under full transparency went.

    Facts, of the original with a_ and of the result with b_: width, height, orientation, resolution, browser, icc, headroom,
    frames, duration. Of the pair: format; exact (pixels must match); hidden_may_change; structure (a violation or null);
    converted (why a re-coded JPEG XL is not its JPEG, or null); text_same (of a text in UTF-16, null else); looks_different (rendered);
    readable; auxiliary_same; auxiliary (how many both have); same_bytes (all but metadata, HEIC); complete; decodes;
    coefficients (status of `comparer_status`); pixels (same, hidden or changed).
    A fact that is null fails no rule, except readable, complete and decodes, whose null means no.
    """
    c = F.col
    differ = lambda name: ~c(f"a_{name}").eqNullSafe(c(f"b_{name}"))
    fmt, exact = c("format"), F.coalesce(c("exact"), F.lit(True))
    no = lambda name: ~F.coalesce(c(name), F.lit(False))
    paired, proven = fmt.isin("jpeg", "heic"), (fmt == "heic") & exact & F.coalesce(c("same_bytes"), F.lit(False))
    drawn = first_failing((c("text_same").isNotNull() & ~c("text_same"), TEXT), (c("text_same").isNull() & c("looks_different"), LOOKS))
    # A GIF's colours under transparency mean nothing.
    hidden = (c("pixels") == "hidden") & (fmt != "gif")
    allowed = F.coalesce(c("hidden_may_change"), F.lit(False))
    raster = first_failing(
        (no("readable") | (c("b_frames") < 1), UNREADABLE),
        (differ("width") | differ("height"), SIZE),
        (differ("orientation"), TURNED),
        (differ("resolution") | ((fmt == "jpeg") & differ("browser")), RESOLUTION),
        (((c("a_frames") > 1) & (c("b_frames") <= 1)) | (~fmt.isin("gif", "png", "webp") & (c("b_frames") < c("a_frames"))), LOST),
        (paired & differ("icc"), PROFILE),
        (paired & ~proven & ~c("auxiliary_same"), LOST),
        (paired & (proven | (c("auxiliary") > 0)) & differ("headroom"), BRIGHTNESS),
        (no("complete"), UNREADABLE),
        ((fmt == "jpeg") & exact & (c("coefficients") == 1), PIXELS),
        ((fmt == "jpeg") & (c("coefficients") == 2), UNREADABLE),
        ((fmt == "jpeg") & (c("coefficients") == 3), DAMAGED),
        ((fmt != "jpeg") & ~exact & no("decodes"), UNREADABLE),
        ((fmt != "jpeg") & exact & ~proven & ((c("a_frames") > 1) | (c("b_frames") > 1)) & differ("duration"), TIMING),
        ((fmt != "jpeg") & exact & ~proven & ((c("pixels") == "changed") | (hidden & ~allowed)), PIXELS),
    )
    said = F.coalesce(c("structure"), F.when(fmt == "jxl", c("converted")).when(fmt == "svg", drawn).otherwise(raster))
    out = pairs.withColumn("rejected", said)
    return out.withColumn("hidden_kept", ~(F.col("rejected").isNull() & F.coalesce(hidden & exact & ~proven & ~fmt.isin("jpeg", "svg", "jxl"), F.lit(False))))


def under_alpha(a: Column, b: Column) -> Column:
    """same, hidden or changed: two frames as arrays of red, green, blue, alpha for each pixel. hidden: they differ only where both are fully transparent."""
    part = lambda x, i: F.slice(x, i * 4 + 1, 4)
    alpha = lambda x, i: F.get(x, i * 4 + 3)
    places = F.sequence(F.lit(0), (F.size(a) / 4).cast("int") - 1)
    only = F.forall(places, lambda i: ((alpha(a, i) == 0) & (alpha(b, i) == 0)) | (part(a, i) == part(b, i)))
    return F.when(a.eqNullSafe(b), "same").when((F.size(a) == F.size(b)) & (F.size(a) >= 4) & only, "hidden").otherwise("changed")


def comparer_status(readable: Column, warnings: Column, differs: Column) -> Column:
    """Status of a comparison of coefficients: 0 the same, 1 different, 2 unreadable, 3 read with warnings only. differs is null where one file is only checked."""
    return F.when(~F.coalesce(readable, F.lit(False)), 2).when(differs, 1).when(F.coalesce(warnings, F.lit(0)) > 0, 3).otherwise(0)


def damage(status: Column) -> Column:
    """What a status says of an original alone; one that cannot be read at all has no coefficients, which is no damage."""
    return F.when(status == 3, DAMAGED).when(status == 1, PIXELS)


def auxiliary_same(a: DataFrame, b: DataFrame, by: list[str], exact: bool) -> DataFrame:
    """(by…, auxiliary_same, auxiliary): whether original and result hold the same kinds, once each, with the same data; without exactness with the
    same size and, where both have samples, a mean difference of at most a hundredth of the range. Rows: by…, kind, data, width, height, samples."""
    cols = ("data", "width", "height", "samples")
    own = lambda df, p: df.select(*by, "kind", *[F.col(n).alias(f"{p}_{n}") for n in cols], F.lit(True).alias(f"{p}_has"))
    both = own(a, "a").join(own(b, "b"), [*by, "kind"], "full")
    there = F.col("a_has").isNotNull() & F.col("b_has").isNotNull()
    sized = F.col("a_width").eqNullSafe(F.col("b_width")) & F.col("a_height").eqNullSafe(F.col("b_height"))
    sampled = F.col("a_samples").isNotNull() & F.col("b_samples").isNotNull()
    near = sized & (~sampled | (mean_difference(F.col("a_samples"), F.col("b_samples")) <= 0.01))
    good = there & (F.col("a_data").eqNullSafe(F.col("b_data")) if exact else F.coalesce(near, F.lit(False)))
    return both.groupBy(*by).agg(F.min(good.cast("int")).alias("s"), F.count_if(there).alias("auxiliary")).select(*by, (F.col("s") == 1).alias("auxiliary_same"), "auxiliary")


def maker_notes_left(tags: DataFrame, by: list[str], level: Column) -> DataFrame:
    """(by…) of files whose maker notes a level removes: any but Apple's, and Apple's with tags other than those that are for display. Rows: by…, maker, tag."""
    shown = policy.DISPLAY <= policy.level_rank(level)
    stays = (F.col("maker") == "Apple") & F.col("tag").isin(*policy.MAKER_NOTE_KEPT) & shown
    return tags.where((level != "keep") & ~F.coalesce(stays, F.lit(False))).select(*by).distinct()


# Images of one file.


def reads_for_encoding(marker: Column, precision: Column, components: Column) -> Column:
    """Whether an encoder reads an image with this frame header: Huffman-coded, 8 bits, grey or three components."""
    return F.coalesce(marker.between(0xC0, 0xC3) & (precision == 8) & components.isin(1, 3), F.lit(False))


def may_change(n: Column, lossy: Column, plain: Column, photo_reads: Column, listed: Column, index: Column, lengths: Column) -> Column:
    """Whether image n (from 0) of a file may change: with loss only the photo of a plain file; else the photo, images that nothing lists, and those whose lengths the container gets anew."""
    return F.when(lossy, plain & (n == 0) & photo_reads).otherwise((n == 0) | ~listed | (F.coalesce(index == "container", F.lit(False)) & lengths))


def images_violation(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by…, violation): images and what lies behind each, paired by number. Rows: by…, n, digest, gap, may_change, gap_stays (of the original).

    Files without a violation have none; the first rule that fails names it: number of images, one that may not change, gaps.
    """
    x = a.select(*by, "n", F.col("digest").alias("a_digest"), F.col("may_change").alias("__may"), F.col("gap").alias("a_gap"), F.col("gap_stays").alias("__stays"), F.lit(1).alias("__a"))
    y = b.select(*by, "n", F.col("digest").alias("b_digest"), F.col("gap").alias("b_gap"), F.lit(1).alias("__b"))
    changed = ~F.col("__may") & ~F.col("a_digest").eqNullSafe(F.col("b_digest"))
    gap = ~F.col("b_gap").eqNullSafe(F.when(F.col("__stays"), F.col("a_gap")).otherwise(F.lit("")))
    found = x.join(y, [*by, "n"], "full").groupBy(*by).agg(
        F.count("__a").alias("na"), F.count("__b").alias("nb"), F.min(F.when(changed, F.col("n"))).alias("at"), F.max(F.coalesce(gap, F.lit(True)).cast("int")).alias("gaps")
    )
    said = first_failing(
        (F.col("na") != F.col("nb"), "images lost or added"), (F.col("at").isNotNull(), F.format_string("image %d changed", F.col("at") + 1)), (F.col("gaps") == 1, "data between or after the images changed")
    )
    return found.select(*by, said.alias("violation")).where("violation IS NOT NULL")


def joined_images(images: DataFrame, by: list[str], order: str, content: str, gap: str) -> DataFrame:
    """(by…, content): images put together again, each before its gap, in their order. Images of one file make one row, so a file has to fit a task."""
    piece = F.struct(F.col(order).alias("o"), F.concat(content, F.coalesce(F.col(gap), F.lit(b""))).alias("c"))
    return images.groupBy(*by).agg(F.array_sort(F.collect_list(piece)).alias("p")).select(*by, F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["c"])).alias(content))


def moved(points: DataFrame, at: str, changes: DataFrame, end: str, delta: str, by: list[str]) -> DataFrame:
    """points with `moved`: their place after all changes that end at or before it, by one running sum over both."""
    rows = points.withColumns({"__p": F.col(at).cast("bigint"), "__d": F.lit(None).cast("bigint"), "__k": F.lit(1)})
    marks = changes.select(*by, F.col(end).cast("bigint").alias("__p"), F.col(delta).cast("bigint").alias("__d"), F.lit(0).alias("__k"))
    w = Window.partitionBy(*by).orderBy("__p", "__k").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.unionByName(marks, allowMissingColumns=True).withColumn("moved", F.col("__p") + F.coalesce(F.sum("__d").over(w), F.lit(0)))
    return run.where("__k = 1").drop("__p", "__d", "__k")


# The end of a chain, and sets of files.


def settled(ends: DataFrame) -> DataFrame:
    """ends with final_size, final_lossy, final_reason: a chosen encoding that fails its last check gives way to the result without loss, and a result whose metadata fail
    against the original gives way to the original (drawings and GIF have no such check). Columns: format, original, size, lossy, lossless_size, chosen_fails, metadata_fails."""
    back = F.col("lossy") & F.coalesce(F.col("chosen_fails"), F.lit(False))
    size = F.when(back, F.col("lossless_size")).otherwise(F.col("size"))
    refused = (size != F.col("original")) & ~F.col("format").isin("svg", "gif") & F.coalesce(F.col("metadata_fails"), F.lit(False))
    return ends.withColumns({
        "final_size": F.when(refused, F.col("original")).otherwise(size),
        "final_lossy": F.col("lossy") & ~back & ~refused,
        "final_reason": F.when(refused, "metadataNotFilterable").when(size == F.col("original"), F.when(back, "resultRejected").otherwise("alreadyOptimal")),
    })


def unexpected(reported: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, side): reported but not expected (extra), or expected but not reported (missing)."""
    tag = lambda df, side: df.select(*keys).distinct().withColumn("__s", F.lit(side))
    return tag(reported, 1).unionByName(tag(expected, 2)).groupBy(*keys).agg(F.sum("__s").alias("s")).where("s < 3").select(*keys, F.when(F.col("s") == 1, "extra").otherwise("missing").alias("side"))


def middle_and_upper(files: DataFrame, by: list[str], size: str, tie: str) -> DataFrame:
    """Of each group the files at half and at three quarters of their order by size, once each: a sample of two. Names, sizes and groups only are ranked."""
    w = Window.partitionBy(*by)
    n, place = F.count("*").over(w), F.row_number().over(w.orderBy(size, tie)) - 1
    ranked = files.withColumns({"__n": n, "__i": place})
    return ranked.where((F.col("__i") == F.floor(F.col("__n") / 2)) | (F.col("__i") == F.floor(F.col("__n") * 3 / 4))).drop("__n", "__i")
