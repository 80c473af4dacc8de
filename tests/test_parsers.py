"""Parsers, rewriters, policy, planner: round trips, strict and lenient reading, damage, seeded mutation. No Spark."""

import random
import struct
import zlib

import pytest

from mediaframe.functions import scalars as sc
from mediaframe.operators import rewrite
from mediaframe.parsers import Malformed, bmff, iptc, jpeg, png, riff, tiff, xmp
from mediaframe.plans import codecs, planner, policy


def grey(w=3, h=2, extra=(), depth=8, interlace=0):
    rows = b"".join(b"\0" + bytes([7] * (-(-w * depth // 8))) for _ in range(h))
    head = struct.pack(">2I5B", w, h, depth, 0, 0, 0, interlace)
    return png.write([("IHDR", head), *extra, ("IDAT", zlib.compress(rows, 0)), ("IEND", b"")])


def photo(segments=(), data=b"\x12\xff\x00\x34"):
    q = bytes([0, *jpeg.scaled_table(90)])
    h = bytes([0, 1, *[0] * 15, 5])
    frame = struct.pack(">B2HB", 8, 8, 8, 1) + bytes([1, 0x11, 0])
    body = b"".join(rewrite.segment(m, p) for m, p in [*segments, (0xDB, q), (0xC4, h), (0xC0, frame), (0xDA, bytes([1, 1, 0, 0, 63, 0]))])
    return b"\xff\xd8" + body + data + b"\xff\xd9"


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def heic(ids=(1, 2), refs=((2, 1),), at=None):
    infe = b"".join(box(b"infe", b"\2\0\0\0" + struct.pack(">2H4s", i, 0, b"hvc1") + b"name\0") for i in ids)
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", len(ids)) + infe)
    iref = box(b"iref", b"\0\0\0\0" + b"".join(box(b"thmb", struct.pack(">3H", a, 1, b)) for a, b in refs))
    make = lambda o: box(b"meta", b"\0\0\0\0" + box(b"pitm", b"\0\0\0\0" + struct.pack(">H", 1)) + iinf + iref + box(b"iloc", b"\0\0\0\0\x44\0" + struct.pack(">H", 1) + struct.pack(">2HH2I", 1, 0, 1, o, 4)))
    ftyp = box(b"ftyp", b"heic\0\0\0\0mif1")
    place = len(ftyp) + len(make(0)) + 8
    return ftyp + make(place if at is None else at) + box(b"mdat", b"abcd")


def test_png_reading_and_damage():
    whole = grey(extra=[("tEXt", b"Title\0hi"), ("zTXt", b"Author\0\0" + zlib.compress(b"me"))])
    parts = png.chunks(whole, strict=True)
    assert [c.kind for c in parts] == ["IHDR", "tEXt", "zTXt", "IDAT", "IEND"] and png.write([(c.kind, c.data) for c in parts]) == whole
    assert png.text_of("zTXt", parts[2].data) == ("Author", b"me") and png.text_of("iTXt", b"K\0\0\0en\0t\0v") == ("K", b"v")
    assert png.violations(whole) == []
    for bad in (whole[:-5], whole + b"x", whole.replace(b"Title", b"Titlf"), b"nothing"):
        with pytest.raises(Malformed):
            png.chunks(bad, strict=True)
    assert len(png.chunks(whole[:-5])) == 4 and not png.chunks(whole.replace(b"Title", b"Titlf"))[1].crc_ok


@pytest.mark.parametrize(
    ("extra", "rule"),
    [
        ([("PLTE", b"abc")], "PLTE in a grey image"),
        ([("gAMA", b"1234"), ("gAMA", b"1234")], "second gAMA"),
        ([("tRNS", b"abc")], "tRNS does not fit"),
        ([("ABCD", b"")], "unknown critical ABCD"),
        ([("fcTL", struct.pack(">I", 3))], "frames not in sequence"),
        ([("sRGB", b"\0"), ("iCCP", b"")], "sRGB and iCCP"),
    ],
)
def test_png_rules(extra, rule):
    assert rule in [r for r, _ in png.violations(grey(extra=extra))]


def test_png_more_rules():
    parts = [(c.kind, c.data) for c in png.chunks(grey())]
    assert ("image data has another size", -1) in png.violations(png.write([parts[0], ("IDAT", zlib.compress(b"\0")), parts[2]]))
    assert any("too late" in r for r, _ in png.violations(png.write([*parts[:2], ("pHYs", b"0" * 9), parts[2]])))
    assert any("foreign tEXt" in r for r, _ in png.violations(grey(extra=[("tEXt", b"A\0b")]), grey()))
    assert sc.png_bytes_of_rows(1, 1, 8, True) == 2 and sc.png_bytes_of_rows(8, 8, 8, True) == 64 + 15


def test_riff():
    data = riff.write([("VP8L", b"\x2f\0\0\0\0"), ("EXIF", b"abc")])
    assert [(c.kind, c.data) for c in riff.webp(data, True)] == [("VP8L", b"\x2f\0\0\0\0"), ("EXIF", b"abc")]
    with pytest.raises(Malformed):
        riff.webp(data + b"x", True)
    assert len(riff.webp(data + b"x")) == 2 and riff.dimensions("VP8L", b"\x2f\0\0\0\0") == (1, 1)
    assert ("simple file with other chunks", -1) in riff.violations(data)
    kept = rewrite.filter_webp(riff.write([("VP8X", bytes([8, *[0] * 9])), ("EXIF", tiff.write([(0x9286, 7, 1, b"x")])), ("VP8L", b"\x2f\0\0\0\0")]), "private")
    assert [c.kind for c in riff.webp(kept, True)] == ["VP8X", "VP8L"] and not riff.violations(kept)


def test_boxes_and_items():
    assert bmff.heif_violations(heic()) == []
    assert ("reference to a missing item", 9) in bmff.heif_violations(heic(refs=((2, 9),)))
    assert ("data outside mdat", 1) in bmff.heif_violations(heic(at=4))
    assert ("item id twice", -1) in bmff.heif_violations(heic(ids=(1, 1, 2)))
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    assert [(b.kind, b.header) for b in bmff.boxes(wide + box(b"free", b""))] == [("free", 16), ("free", 8)]
    for bad in (b"\0\0\0\x07free", b"\0\0\0\x20free", wide + b"abc"):
        with pytest.raises(Malformed):
            bmff.boxes(bad)
    assert bmff.movie_holds_metadata(box(b"moov", box(b"udta", b""))) is True and bmff.movie_holds_metadata(box(b"mdat", b"x")) is False and bmff.movie_holds_metadata(b"abc") is None


def test_jxl():
    part = lambda n, last: box(b"jxlp", struct.pack(">I", n | last << 31))
    ok = bmff.jxl(bmff.JXL_SIGNATURE + part(0, 0) + box(b"jbrd", b"") + part(1, 1) + box(b"brob", b"Exif...."))
    assert ok.from_jpeg and ok.needs_brotli == 1
    for bad in (part(0, 0), part(1, 1), b"", part(0, 1) + part(1, 1)):
        with pytest.raises(Malformed):
            bmff.jxl(bmff.JXL_SIGNATURE + bad)


def test_jpeg_structure():
    p = photo([(0xE0, b"JFIF\0\1\1"), (0xE1, b"Exif\0\0" + tiff.write([(274, 3, 1, b"\6\0")])), (0xFE, b"hello")])
    assert [s.kind for s in jpeg.headers(p)[0]][:3] == ["jfif", "exif", "comment"] and jpeg.image_end(p) == len(p) and jpeg.violations(p) == []
    assert ("data after EOI", -1) in jpeg.violations(p + b"x")
    assert any("foreign comment" == r for r, _ in jpeg.violations(p, photo()))
    assert any("restart" in r for r, _ in jpeg.violations(photo(data=b"\x12\xff\xd1\x34")))
    assert jpeg.violations(photo(data=b"\x12\xff\xd0\x34\xff\xd1")) == []
    two = p + photo()
    assert jpeg.layout(two).images == [(0, len(p)), (len(p), len(two))] and jpeg.layout(two).problem == "unlisted"
    assert jpeg.layout(p + box(b"ftyp", b"mp42" + b"\0" * 4)).problem == "video" and jpeg.layout(p).problem == ""
    with pytest.raises(Malformed):
        jpeg.huffman_tables(bytes([0, 3, *[0] * 15, 1, 2, 3]))
    assert all(jpeg.scaled_table(jpeg.estimate_quality(jpeg.scaled_table(q))) and sum(jpeg.scaled_table(jpeg.estimate_quality(jpeg.scaled_table(q)))) == sum(jpeg.scaled_table(q)) for q in range(1, 101))


def test_multi_picture_index():
    entries = struct.pack("<3I2H", 0x030000, 100, 0, 0, 0) + struct.pack("<3I2H", 0, 50, 92, 0, 0)
    block = tiff.write([(0xB000, 7, 4, b"0100"), (0xB002, 7, 32, entries)])
    assert jpeg.multi_picture(b"MPF\0" + block, base=8) == [(0, 100), (100, 50)]


def test_extended_xmp():
    data = b"a" * 100
    pieces = [("g", 100, 60, data[60:]), ("g", 100, 0, data[:60])]
    assert jpeg.extended_xmp(pieces) == data
    for bad in (pieces[:1], [*pieces, ("g", 100, 50, b"x")], [("h", 100, 0, data[:60]), pieces[0]]):
        with pytest.raises(Malformed):
            jpeg.extended_xmp(bad)
    assert len(rewrite.extended_segments(b"z" * 70000)) == 2


@pytest.mark.parametrize("big", [True, False])
def test_tiff(big):
    order = ">" if big else "<"
    data = tiff.write([(0x010F, 2, 6, b"Maker\0"), (0x0112, 3, 1, struct.pack(order + "H", 6)), (0x0131, 2, 9, b"Software\0")], big)
    got = tiff.entries(data)
    assert [e.tag for e in got] == [0x010F, 0x0112, 0x0131] and rewrite.orientation_of(data) == 6
    kept = tiff.entries(rewrite.filter_exif(data, "private"))
    assert [e.tag for e in kept] == [0x010F, 0x0112] and [e.tag for e in tiff.entries(rewrite.filter_exif(data, "none"))] == [0x0112]
    ring = bytearray(data)
    ring[8 + 2 + 36 : 8 + 2 + 40] = struct.pack(order + "I", 8)
    with pytest.raises(Malformed):
        tiff.entries(bytes(ring))
    assert rewrite.filter_exif(bytes(ring), "private") == b""


def test_iptc_digest():
    import hashlib

    d = lambda r, k, v: bytes([0x1C, r, k]) + struct.pack(">H", len(v)) + v
    iim = d(2, 80, b"me") + d(2, 90, b"town")
    assert [x.data for x in iptc.datasets(iim)] == [b"me", b"town"] and iptc.datasets(b"\x1c\x02\x78\x80\x04\0\0\0\1x")[0].data == b"x"
    block = iptc.write_resources([iptc.Resource(0x0404, b"", iim), iptc.Resource(0x0425, b"", hashlib.md5(iim).digest()), iptc.Resource(0x1234, b"n", b"odd")])
    assert [r.number for r in iptc.resources(block, True)] == [0x0404, 0x0425, 0x1234]
    out = iptc.resources(iptc.filtered(block, lambda n: policy.keeps(policy.resource_group(n), "copyright"), lambda r, k: policy.keeps(policy.iim_group(r, k), "copyright")), True)
    assert [r.number for r in out] == [0x0404, 0x0425] and out[1].data == hashlib.md5(out[0].data).digest() and b"town" not in out[0].data
    with pytest.raises(Malformed):
        iptc.datasets(iim + b"\x1c\x02")


PACKET = b"""<?xpacket begin="" id="x"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="q"
 xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:CreatorTool="t" dc:format="f"><dc:creator><rdf:Seq><rdf:li>A &amp; B</rdf:li><rdf:li>C</rdf:li></rdf:Seq></dc:creator>
<dc:title>T</dc:title></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>"""


def test_xmp():
    assert {(f.name, f.text) for f in xmp.fields(PACKET)} == {("CreatorTool", "t"), ("format", "f"), ("creator", "A & B|C"), ("title", "T")}
    assert {f.name for f in xmp.fields(xmp.filtered(PACKET, rewrite.xmp_keep("private")))} == {"creator", "title"}
    assert {f.name for f in xmp.fields(xmp.filtered(PACKET, rewrite.xmp_keep("copyright")))} == {"creator"}
    assert xmp.filtered(PACKET, rewrite.xmp_keep("none")) == b"" and xmp.filtered(b"<broken", lambda *_: True) == b""
    with pytest.raises(Malformed):
        xmp.fields(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')


def test_google_container():
    ns = "http://ns.google.com/photos/1.0/container/"
    data = f'<a xmlns:C="{ns}" xmlns:I="{ns}item/"><C:Directory><b><C:Item I:Semantic="Primary" I:Mime="image/jpeg" I:Padding="2"/><C:Item I:Semantic="MotionPhoto" I:Mime="video/mp4" I:Length="30"/></b></C:Directory></a>'.encode()
    items = xmp.directories(data)[0]
    assert [i.semantic for i in items] == ["Primary", "MotionPhoto"] and xmp.arrangement(items, 100, 70) == [(70, 100)] and xmp.arrangement(items, 102, 70, from_end=False) == [(72, 102)]
    with pytest.raises(Malformed):
        xmp.arrangement(items, 90, 70)


@pytest.mark.parametrize(
    ("inner", "reason"),
    [("<script/><animate/>", "script"), ("<rect onload=''/>", "script"), ("<set/>", "animation"), ("<foreignObject/>", "html"), ("<style>a{fill:var( --x)}</style>", "css"), ("<style>@charset 'x';</style>", None), ("<rect/>", None)],
)
def test_svg_reasons(inner, reason):
    svg = f"<svg xmlns='http://www.w3.org/2000/svg'>{inner}</svg>".encode()
    assert xmp.uncheckable(svg) == reason and xmp.svg_violations(svg, svg) == [] and xmp.svg_violations(b"<a/>", svg) and xmp.svg_violations(b"\xff", svg)


def test_png_filter_levels():
    exif = tiff.write([(0x0112, 3, 1, b"\6\0"), (0x0131, 2, 9, b"Software\0")])
    data = grey(extra=[("eXIf", exif), ("tEXt", b"Author\0me"), ("tEXt", b"Title\0t"), ("tEXt", b"Other\0o"), ("tIME", b"1234567"), ("pHYs", b"0" * 9)])
    kinds = lambda level: [(c.kind, c.data.split(b"\0")[0]) if c.kind == "tEXt" else c.kind for c in png.chunks(rewrite.filter_png(data, level), True)]
    assert kinds("private") == ["IHDR", "eXIf", ("tEXt", b"Author"), ("tEXt", b"Title"), "pHYs", "IDAT", "IEND"]
    assert kinds("none") == ["IHDR", "eXIf", "pHYs", "IDAT", "IEND"] and rewrite.filter_png(data, "keep") == data


def test_jpeg_filter_and_transplant():
    data = photo([(0xE0, b"JFIF\0\1\1"), (0xFE, b"secret"), (0xE1, b"Exif\0\0" + tiff.write([(0x0112, 3, 1, b"\6\0"), (0x8825, 4, 1, b"\x08\0\0\0")])), (0xEE, b"Adobe")])
    out = rewrite.filter_jpeg(data, "none")
    assert [s.kind for s in jpeg.headers(out)[0]][:3] == ["jfif", "exif", "adobe"] and b"secret" not in out and jpeg.violations(out) == []
    assert "comment" in [s.kind for s in jpeg.headers(rewrite.transplant(photo(), data))[0]]


def test_policy_levels():
    g = lambda n, k: policy.xmp_group(policy.NS[n], k)
    assert [g("dc", "creator"), g("dc", "title"), g("exif", "GPSAltitude"), g("tiff", "Make"), g("GCamera", "PortraitX"), g("GCamera", "Y"), policy.xmp_group("urn:x", "y")] == [2, 3, 8, 3, 1, 8, 8]
    assert policy.xmp_group(policy.DISPLAY_ONLY[0], "anything") == 1 and policy.derivable(policy.NS["dc"], "format")
    assert [policy.exif_group("exif", t) for t in (0x8833, 0x9286, 0xA002, 0xA405, 0x927C)] == [3, 8, 1, 3, 8] and policy.exif_group("gps", 1) == 8
    assert policy.iim_group(2, 80) == 2 and policy.iim_group(2, 90) == 8 and policy.resource_group(0x07D5) == 2
    for group, levels in ((1, 3), (2, 2), (3, 1), (8, 0)):
        assert sum(policy.keeps(group, x) for x in ("none", "copyright", "private")) == levels and policy.keeps(group, "keep")


def test_planner():
    s = planner.Settings
    names = lambda *a: [[c.name for c in g] for g in planner.stages(*a)]
    assert names("png", {}, s(effort="high")) == [["metadata"], ["oxipng -o 2 -f 0-9 --zc 14"]]
    assert names("png", {}, s(lossy=True, effort="fast")) == [["metadata"], ["oxipng -o 2"], ["quantizr"], ["oxipng -o 2"]]
    assert len(names("png", {}, s(effort="max"))[1]) == 2 and len(names("png", {"is_animated": True}, s(effort="max"))[1]) == 1
    assert names("webp", {"is_lossless_webp": True}, s()) == [["cwebp -z 9", "cwebp -z 7"]] and names("webp", {"is_lossless_webp": True}, s(effort="fast")) == [["cwebp -z 7"]]
    required = lambda *a: [c.required for g in planner.stages(*a) for c in g]
    assert required("heic", {}, s(lossy=True)) == [False, False] and required("heic", {"bits": 10}, s(lossy=True)) == [True] and required("heic", {}, s()) == [True]
    assert names("jpeg", {"jpeg_quality": 85}, s(lossy=True)) == [["metadata"], ["jpeg-scan"]] and names("jpeg", {}, s(lossy=True))[0] == ["jpegli"]
    assert names("gif", {}, s()) == [] and names("jxl", {"from_jpeg": True}, s()) == [["jxl-recompress"]]
    assert names("svg", {"is_utf16": True, "is_uncheckable": True}, s()) == [["utf-8"]] and names("heic", {"bits": 10}, s(lossy=True)) == [["metadata"]]
    assert names("jpeg", {}, s(chooser=True))[-2:] == [["chosen jpegli"], ["jpeg-scan"]]
    for bad in ({"quality": 0}, {"effort": "x"}, {"suffix": " "}, {"suffix": "a/b"}, {"output": "folder"}, {"disabled": frozenset({"bmp"})}):
        with pytest.raises(ValueError):
            s(**bad)


def test_redeflate_and_code_lengths():
    data = png.write([("IHDR", struct.pack(">2I5B", 100, 1, 8, 0, 0, 0, 0)), ("IDAT", zlib.compress(b"\0" * 101, 0)[:20]), ("IDAT", zlib.compress(b"\0" * 101, 0)[20:]), ("IEND", b"")])
    out = codecs.redeflate_png(data)
    assert len(out) < len(data) and png.violations(out, data) == [] and codecs.redeflate_png(out) is None
    lengths = rewrite.code_lengths([1, 1, 2, 4, 8, 16, 0], 5)
    assert sum(2.0**-x for x in lengths if x) == 1 and max(lengths) <= 5 and lengths[6] == 0
    fib = [1, 1]
    while len(fib) < 25:
        fib.append(fib[-1] + fib[-2])
    limited = rewrite.code_lengths(fib, 16)
    assert max(limited) == 16 and sum(2.0**-x for x in limited) == 1


def test_bounded_inflate():
    bomb = zlib.compress(b"\0" * (1 << 20))
    assert sc.inflate_exact(bomb, 1 << 10) is None and len(sc.inflate_exact(bomb, 1 << 20)) == 1 << 20
    assert sc.inflate_exact(bomb + b"x") is None and sc.inflate_exact(bomb[:-1]) is None and sc.inflate_exact(b"junk") is None


def mutate(data, r):
    b = bytearray(data)
    for _ in range(r.randint(1, 4)):
        k, at = r.randrange(6), r.randrange(max(1, len(b)))
        if k == 0 and b:
            b[at] ^= 1 << r.randrange(8)
        elif k == 1 and b:
            b[at] = r.choice((0, 0xFF, 0x7F, 0x80))
        elif k == 2:
            del b[at:]
        elif k == 3:
            del b[at : at + r.randint(1, 8)]
        elif k == 4:
            b[at:at] = bytes(r.randrange(256) for _ in range(r.randint(1, 8)))
        else:
            b[at:at] = b[max(0, at - 16) : at]
    return bytes(b)


def test_mutated_files_never_crash():
    r = random.Random(1234)
    exif = tiff.write([(0x010F, 2, 6, b"Maker\0"), (0x8769, 4, 1, b"\x1a\0\0\0")])
    readers = {
        grey(extra=[("tEXt", b"Title\0hi"), ("eXIf", exif)]): [png.violations, lambda d: rewrite.filter_png(d, "private")],
        photo([(0xE1, b"Exif\0\0" + exif), (0xED, b"Photoshop 3.0\0" + iptc.write_resources([iptc.Resource(0x0404, b"", b"\x1c\x02\x50\0\1x")]))]): [jpeg.violations, jpeg.layout, lambda d: rewrite.filter_jpeg(d, "copyright")],
        riff.write([("VP8X", bytes(10)), ("VP8L", b"\x2f\0\0\0\0"), ("XMP ", PACKET)]): [riff.violations, lambda d: rewrite.filter_webp(d, "private")],
        heic(): [bmff.heif_violations],
        exif: [tiff.entries],
        PACKET: [xmp.fields, xmp.directories, lambda d: xmp.filtered(d, lambda *_: True)],
    }
    for data, functions in readers.items():
        for _ in range(60):
            bad = mutate(data, r)
            for f in functions:
                try:
                    f(bad)
                except Malformed:
                    pass


def test_assembled_files_have_a_right_index():
    entries = lambda n: b"".join(struct.pack("<3I2H", 0, 1, 1 if k else 0, 0, 0) for k in range(n))
    index = lambda n: b"MPF\0" + tiff.write([(0xB000, 7, 4, b"0100"), (0xB002, 7, 16 * n, entries(n))])
    whole = jpeg.assembled([photo([(0xE2, index(2))]), photo()], [b"\0\0", b""])
    assert jpeg.index_violations(whole) == [] and jpeg.layout(whole).problem == "" and jpeg.layout(whole).gaps == [2, 0]
    assert jpeg.index_violations(whole.replace(b"\0\0\xff\xd8", b"\0\0\0\xff\xd8")) != []
    with pytest.raises(Malformed):
        jpeg.assembled([photo([(0xE2, index(3))]), photo()])


def test_fields_of_files():
    from mediaframe.operators import fields

    exif = tiff.write([(0x010F, 2, 6, b"Maker\0"), (0x0131, 2, 9, b"Software\0")])
    got = fields.of_png(grey(extra=[("eXIf", exif), ("tEXt", b"Author\0me"), ("iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + PACKET)]))
    assert {(f[0], f[2], f[4]) for f in got} == {("exif", "0x010F", 3), ("exif", "0x0131", 8), ("png_text", "Author", 2), ("xmp", "CreatorTool", 8), ("xmp", "format", 3), ("xmp", "creator", 2), ("xmp", "title", 3)}
    iim = iptc.write_resources([iptc.Resource(0x0404, b"", b"\x1c\x02\x50\0\x02me")])
    got = fields.of_jpeg(photo([(0xED, b"Photoshop 3.0\0" + iim), (0xFE, b"hi"), (0xE1, b"Exif\0\0broken")]))
    assert [(f[0], f[4]) for f in got] == [("iim", 2), ("comment", 8), ("exif", 8)]
    assert fields.of_webp(riff.write([("VP8L", b"\x2f\0\0\0\0"), ("EXIF", exif)]))[0][2] == "0x010F"


def test_regions_and_manifests():
    from mediaframe.parsers import regions

    text, words = b"x" * 5, b"jumb c2pa"
    jpg = lambda marker: b"\xff\xd8" + struct.pack(">2BH", 0xFF, marker, len(words) + 2) + words + b"\xff\xda\0\x08\x01\x01\0\0\x3f\0" + b"\xff\xd9"
    assert regions.regions(jpg(0xE1)) == [("E1", words)] and regions.regions(jpg(0xDB)) == []
    assert regions.holds_manifest(jpg(0xEB), "jpeg") and not regions.holds_manifest(jpg(0xE1), "jpeg")
    assert regions.regions(words + text) == [("", words + text)] and regions.holds_manifest(words, "png")
    image = lambda kind: png.write([("IHDR", struct.pack(">2I5B", 1, 1, 8, 0, 0, 0, 0)), (kind, words), ("IEND", b"")])
    assert regions.holds_manifest(image("caBX"), "png") and not regions.holds_manifest(image("IDAT"), "png")
    assert jpeg.holds_video(b"abcSEFT") and not jpeg.holds_video(b"SEFTabc")


def test_items_counted_from_the_end_have_their_padding_behind():
    item = lambda n, p=0: xmp.ContainerItem("", "", n, p)
    assert xmp.arrangement([item(0), item(10, 5)], 100, 20) == [(85, 95)]
    assert xmp.arrangement([item(0, 3), item(10, 5), item(4)], 100, 20, False) == [(23, 33), (38, 42)]


def test_exif_filter_keeps_interop_and_drops_what_says_nothing():
    entry = lambda tag, kind, count, value: (tag, kind, count, value)
    short = lambda tag, n: entry(tag, 3, 1, struct.pack("<H", n))
    rest = lambda at: struct.pack("<I", at)

    def block(main, exif, interop=()):
        inner = [*exif, *([entry(0xA005, 4, 1, rest(0))] if interop else [])]
        first = [*main, entry(0x8769, 4, 1, rest(0))]
        at = 8 + len(tiff._directory(first, 8, "<"))
        far = at + len(tiff._directory(inner, at, "<"))
        out = b"II" + struct.pack("<HI", 42, 8) + tiff._directory([*main, entry(0x8769, 4, 1, rest(at))], 8, "<")
        return out + tiff._directory([*exif, *([entry(0xA005, 4, 1, rest(far))] if interop else [])], at, "<") + (tiff._directory(list(interop), far, "<") if interop else b"")

    told = lambda data: sorted((e.ifd, e.tag, e.value) for e in tiff.entries(data) if e.tag not in tiff.POINTERS)
    version, mark = entry(0x9000, 7, 4, b"0232"), entry(1, 2, 4, b"R03\0")
    whole = block([short(0x0112, 6)], [version, entry(0x829A, 5, 1, struct.pack("<2I", 1, 60))], [mark])
    assert told(tiff.filtered(whole, lambda *_: True)) == told(whole) and ("interop", 1, b"R03\0") in told(whole)
    assert told(tiff.filtered(block([short(0x0112, 6)], [version, short(0xA001, 1)]), lambda *_: True)) == [("ifd0", 0x0112, struct.pack("<H", 6))]
    assert tiff.filtered(block([short(0x0112, 1)], [version]), lambda *_: True) == b""
    assert len(told(tiff.filtered(block([], [version, short(0xA001, 2)]), lambda *_: True))) == 2


def test_srgb_is_known_by_its_id_not_by_its_name():
    fake = b"\0" * 64 + b"\0\0\0\x01" + b"\0" * 60 + b"sRGB IEC61966-2.1"
    assert rewrite.srgb_intent(fake) is None and rewrite.srgb_intent(b"") is None
    named = bytearray(fake)
    named[84:100] = bytes.fromhex("29f83ddeaff255ae7842fae4ca83390d")
    assert rewrite.srgb_intent(bytes(named)) is None


def test_results_are_never_replaced(spark, tmp_path):
    from pyspark.sql import functions as F

    from mediaframe.sources import files

    df = spark.createDataFrame([("a/b.bin", b"one")], "name string, content binary")
    for _ in range(2):
        assert [tuple(r) for r in files.write_files(df, str(tmp_path)).collect()] == [("a/b.bin", 3)]
    with pytest.raises(Exception, match="FileExistsError"):
        files.write_files(df.withColumn("content", F.lit(b"two")), str(tmp_path)).collect()
    assert (tmp_path / "a" / "b.bin").read_bytes() == b"one"


def note(entries, order=">", maker=b"Apple iOS\0"):
    """A maker note: values over four bytes behind the directory, offsets from the note's start."""
    head, tail, base = [], b"", 14 + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        spot = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", base + len(tail))
        tail += value if len(value) > 4 else b""
        head.append(struct.pack(order + "2HI", tag, kind, count) + spot)
    return maker + b"\0\1" + (b"MM" if order == ">" else b"II") + struct.pack(order + "H", len(entries)) + b"".join(head) + bytes(4) + tail


@pytest.mark.parametrize("order", [">", "<"])
def test_maker_note_keeps_what_is_for_display(order):
    ratio = struct.pack(order + "2i", 3, 7)
    whole = note([(8, 4, 1, struct.pack(order + "I", 5)), (17, 2, 6, b"ABCDE\0"), (33, 10, 1, ratio), (48, 10, 1, ratio)], order)
    shown = lambda tag: tag in policy.MAKER_NOTE_KEPT
    kept = tiff._Note(tiff.maker_note(whole, shown)).ifd(14)
    assert [(e.tag, e.value) for e in kept] == [(17, b"ABCDE\0"), (33, ratio), (48, ratio)]
    assert tiff.maker_note(note([(8, 3, 1, b"\0\1")], order), shown) == b""
    assert tiff.maker_note(whole.replace(b"Apple", b"Ample"), shown) == b""
    assert tiff.maker_note(whole[:20], shown) == b"" and tiff.maker_note(b"", shown) == b""
    # An entry whose value lies outside is left out, the others stay.
    cut = tiff.maker_note(whole[:-8], shown)
    assert [e.tag for e in tiff._Note(cut).ifd(14)] == [17, 33]


def test_exif_keeps_the_part_of_a_maker_note_that_is_for_display():
    ratio = struct.pack(">2i", 3, 7)
    own = note([(8, 4, 1, bytes(4)), (33, 10, 1, ratio)])
    exif_at = 8 + 2 + 12 + 4
    data = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H2HII", 1, 0x8769, 4, 1, exif_at) + bytes(4)
    data += struct.pack(">H2HII", 1, 0x927C, 7, len(own), exif_at + 18) + bytes(4) + own
    for level in ("none", "copyright", "private"):
        out = rewrite.filter_exif(data, level)
        left = [e.value for e in tiff.entries(out) if e.tag == 0x927C]
        assert len(left) == 1 and [e.tag for e in tiff._Note(left[0]).ifd(14)] == [33]
    other = data.replace(b"Apple", b"Ample")
    assert rewrite.filter_exif(other, "private") == b"" and rewrite.filter_exif(other, "keep") == other
