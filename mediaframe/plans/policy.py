"""The metadata policy as a table: which group each field belongs to, and which groups a level keeps.

Groups widen: display, rights, image information. A field without a group goes at every level but keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels with the widest group that they keep.
LEVELS = {"none": 1, "copyright": 2, "private": 3, "keep": 9}
DISPLAY, RIGHTS, INFO, REMOVED = 1, 2, 3, 8

# Namespaces.
NS = {
    "dd": "http://ns.google.com/photos/dd/1.0/device/",
    "GCamera": "http://ns.google.com/photos/1.0/camera/",
    "tiff": "http://ns.adobe.com/tiff/1.0/",
    "exif": "http://ns.adobe.com/exif/1.0/",
    "exifEX": "http://cipa.jp/exif/1.0/",
    "aux": "http://ns.adobe.com/exif/1.0/aux/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "xmpRights": "http://ns.adobe.com/xap/1.0/rights/",
    "plus": "http://ns.useplus.org/ldf/xmp/1.0/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "Iptc4xmpCore": "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/",
    "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/",
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "lightroom": "http://ns.adobe.com/lightroom/1.0/",
    "mwg-kw": "http://www.metadataworkinggroup.com/schemas/keywords/",
    "pdf": "http://ns.adobe.com/pdf/1.3/",
}
DISPLAY_ONLY = (
    "http://ns.adobe.com/hdr-gain-map/1.0/",
    "http://ns.apple.com/pixeldatainfo/1.0/",
    "http://ns.apple.com/HDRGainMap/1.0/",
    "http://ns.apple.com/depthData/1.0/",
    "http://ns.apple.com/portraitEffectsMatte/1.0/",
    "http://ns.apple.com/semanticSegmentationMatte/1.0/",
    "http://ns.google.com/photos/1.0/container/",
    "http://ns.google.com/photos/1.0/container/item/",
    "http://ns.google.com/photos/dd/1.0/container/",
    "http://ns.google.com/photos/dd/1.0/item/",
    "http://ns.google.com/photos/1.0/panorama/",
    "http://ns.google.com/photos/1.0/depthmap/",
    "http://ns.google.com/photos/1.0/image/",
)

# By prefix the exact names of each group, name prefixes, and the group of all other names.
XMP: dict[str, dict] = {
    "dd": {DISPLAY: "Container Cameras Profiles", "other": REMOVED},
    "GCamera": {DISPLAY: "SpecialTypeID DisableSuggestedAction DisableAutoCreation", "prefix": {"MotionPhoto": DISPLAY, "MicroVideo": DISPLAY, "Portrait": DISPLAY, "RelitInputImage": DISPLAY}, "other": REMOVED},
    "tiff": {
        DISPLAY: "Orientation ImageWidth ImageLength TileWidth TileLength BitsPerSample Compression PhotometricInterpretation SamplesPerPixel PlanarConfiguration YCbCrSubSampling YCbCrPositioning "
        "TransferFunction WhitePoint PrimaryChromaticities XResolution YResolution ResolutionUnit",
        RIGHTS: "Artist Copyright",
        REMOVED: "Software NativeDigest",
        "other": INFO,
    },
    "exif": {DISPLAY: "ColorSpace Gamma ExifVersion PixelXDimension PixelYDimension", REMOVED: "UserComment ImageUniqueID MakerNote NativeDigest RelatedSoundFile", "prefix": {"GPS": REMOVED}, "other": INFO},
    "exifEX": {DISPLAY: "Gamma", REMOVED: "BodySerialNumber LensSerialNumber CameraOwnerName ImageUniqueID", "other": INFO},
    "aux": {REMOVED: "SerialNumber LensSerialNumber OwnerName ImageNumber", "other": INFO},
    "dc": {RIGHTS: "creator rights copyright", REMOVED: "coverage", "other": INFO},
    "xmpRights": {"other": RIGHTS},
    "plus": {"other": RIGHTS},
    "photoshop": {RIGHTS: "Credit Source AuthorsPosition LegacyIPTCDigest", REMOVED: "City State Country DocumentAncestors History TextLayers", "other": INFO},
    "Iptc4xmpCore": {RIGHTS: "CreatorContactInfo", REMOVED: "Location CountryCode", "other": INFO},
    "Iptc4xmpExt": {
        DISPLAY: "DigitalSourceType",
        RIGHTS: "LinkedEncRightsExpr EmbdEncRightsExpr",
        REMOVED: "LocationCreated LocationShown PersonInImage PersonInImageWDetails ImageRegion ModelAge",
        "other": INFO,
    },
    "xmp": {REMOVED: "Thumbnails CreatorTool", "other": INFO},
    "lightroom": {INFO: "hierarchicalSubject weightedFlatSubject", "other": REMOVED},
    "mwg-kw": {"other": INFO},
    "pdf": {RIGHTS: "Author", INFO: "Keywords Title Subject", "other": REMOVED},
}
# XMP fields that follow from the image and are dropped below keep.
DERIVABLE = {
    "dc": "format",
    "photoshop": "ColorMode",
    "xmp": "MetadataDate",
    "exif": "PixelXDimension PixelYDimension",
    "tiff": "ImageWidth ImageLength BitsPerSample Compression PhotometricInterpretation SamplesPerPixel PlanarConfiguration",
}

# EXIF tags, ranges in both ends included.
EXIF: dict[str, dict[int, list]] = {
    "ifd0": {
        DISPLAY: [0x0112, 0x012D, 0x013E, 0x013F, 0x011A, 0x011B, 0x0128],
        RIGHTS: [0x013B, 0x8298, 0x9C9D],
        INFO: [0x010E, 0x010F, 0x0110, 0x0132, 0x0213, 0x4746, 0x4749, 0x9C9B, 0x9C9C, 0x9C9E, 0x9C9F],
    },
    "exif": {
        DISPLAY: [0xA001, 0xA500, 0x9000, 0xA002, 0xA003],
        INFO: [
            0x829A, 0x829D, 0x8822, 0x8824, 0x8827, (0x8830, 0x8835), 0x9003, 0x9004, (0x9010, 0x9012), 0x9101, 0x9102, (0x9201, 0x920A), 0x9214, (0x9290, 0x9292), (0x9400, 0x9405), 0xA000,
            0xA20B, (0xA20E, 0xA210), 0xA214, 0xA215, 0xA217, (0xA300, 0xA302), (0xA401, 0xA40C), (0xA432, 0xA434), (0xA460, 0xA462),
        ],
    },
    "interop": {DISPLAY: [(0, 0xFFFF)]},
}
MAKER_NOTE_KEPT = (17, 33, 48)

# IIM datasets as (record, dataset), Photoshop resources, keywords of PNG texts, chunks and segments that always stay.
IIM = {
    RIGHTS: [(1, 0), (1, 90), (2, 0), (2, 80), (2, 85), (2, 110), (2, 115), (2, 116), (2, 118)],
    INFO: [(2, d) for d in (4, 5, 7, 8, 10, 12, 15, 20, 22, 25, 30, 35, 37, 38, 40, 45, 47, 50, 55, 60, 62, 63, 103, 105, 120, 122)],
}
RESOURCES = {DISPLAY: [0x03ED], RIGHTS: [0x0404, 0x0425, 0x040A, 0x040B, (0x07D0, 0x0BB7)]}
PNG_TEXTS = {RIGHTS: ["Author", "Copyright", "Disclaimer"], INFO: ["Title", "Description", "Creation Time", "Source", "Warning"]}
PNG_KEPT = "tRNS iCCP sRGB gAMA cHRM sBIT cICP mDCV cLLI pHYs acTL fcTL fdAT".split()
JPEG_KEPT = "iccProfile adobe jfif multiPicture isoGainMap".split()


def _within(value: int, listed: list) -> bool:
    return any(x[0] <= value <= x[1] if isinstance(x, tuple) else x == value for x in listed)


def xmp_group(ns: str, name: str) -> int:
    """Group of an XMP field: exact name, then name prefix, then what the namespace says of all others."""
    if ns in DISPLAY_ONLY:
        return DISPLAY
    own = next((XMP[k] for k, v in NS.items() if v == ns), None)
    if own is None:
        return REMOVED
    for group in (DISPLAY, RIGHTS, INFO, REMOVED):
        if name in own.get(group, "").split():
            return group
    return next((g for p, g in own.get("prefix", {}).items() if name.startswith(p)), own["other"])


def derivable(ns: str, name: str) -> bool:
    return any(NS[k] == ns and name in v.split() for k, v in DERIVABLE.items())


def exif_group(ifd: str, tag: int) -> int:
    return next((g for g, listed in EXIF.get(ifd, {}).items() if _within(tag, listed)), REMOVED)


def iim_group(record: int, dataset: int) -> int:
    return next((g for g, listed in IIM.items() if (record, dataset) in listed), REMOVED)


def resource_group(number: int) -> int:
    return next((g for g, listed in RESOURCES.items() if _within(number, listed)), REMOVED)


def png_text_group(keyword: str) -> int:
    return next((g for g, listed in PNG_TEXTS.items() if keyword in listed), REMOVED)


def keeps(group: int, level: str) -> bool:
    return level == "keep" or group <= LEVELS[level] < REMOVED


def table(spark: SparkSession) -> DataFrame:
    """The policy of XMP as rows (ns, name, match, rank, derivable): match is exact, prefix or default. A few hundred rows, whatever the input."""
    rows = []
    for k, own in XMP.items():
        for group in (DISPLAY, RIGHTS, INFO, REMOVED):
            rows += [(NS[k], n, "exact", group) for n in own.get(group, "").split()]
        rows += [(NS[k], p, "prefix", g) for p, g in own.get("prefix", {}).items()]
        rows.append((NS[k], "", "default", own["other"]))
    rows += [(ns, "", "default", DISPLAY) for ns in DISPLAY_ONLY]
    return spark.createDataFrame(rows, "ns string, name string, match string, rank int")


def with_group(fields: DataFrame, ns: str = "ns", name: str = "name") -> DataFrame:
    """fields with rank and derivable: broadcast joins with the policy, an exact name before a prefix before the namespace's default."""
    p = table(fields.sparkSession)
    exact = F.broadcast(p.where("match = 'exact'").select(F.col("ns").alias("__n1"), F.col("name").alias("__m1"), F.col("rank").alias("__r1")))
    prefixes = [r for r in p.where("match = 'prefix'").collect()]  # a handful of constants
    default = F.broadcast(p.where("match = 'default'").select(F.col("ns").alias("__n3"), F.col("rank").alias("__r3")))
    by_prefix = F.lit(None).cast("int")
    for r in prefixes:
        by_prefix = F.when((F.col(ns) == r.ns) & F.startswith(F.col(name), F.lit(r.name)), r["rank"]).otherwise(by_prefix)
    out = fields.join(exact, (F.col(ns) == F.col("__n1")) & (F.col(name) == F.col("__m1")), "left").join(default, F.col(ns) == F.col("__n3"), "left")
    flag = F.lit(False)
    for k, names in DERIVABLE.items():
        flag = flag | ((F.col(ns) == NS[k]) & F.col(name).isin(*names.split()))
    return out.withColumn("rank", F.coalesce("__r1", by_prefix, "__r3", F.lit(REMOVED))).withColumn("derivable", flag).drop("__n1", "__m1", "__r1", "__n3", "__r3")


def level_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)]), level)


def removed_at(rank: Column, derivable_: Column, level: Column) -> Column:
    """Whether a level removes a field: its group is wider than the level's, or it can be derived."""
    return (level != "keep") & ((rank > level_rank(level)) | derivable_)
