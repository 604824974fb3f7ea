"""Rasters to PNG files and back through Spark's image source; listings and manifests."""

import hashlib
import struct
import zlib

from lumenmill.operators import metrics
from lumenmill.sources import fixtures, images

SF = "/root/testdata/sf0.001"


def test_png_round_trip(spark, tmp_path):
    px = fixtures.px(spark, SF).where("image_id < 4").cache()
    written = images.write_files(images.encode(px), str(tmp_path)).collect()
    assert {r.image_id for r in written} == {0, 1, 2, 3} and not list(tmp_path.glob("*.part"))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path))
    assert {(r.width, r.height, r.n_channels, r.has_alpha, r.has_real_alpha) for r in read.collect()} == {(32, 32, 1, False, False)}
    back = {(int(r.origin.rsplit("/", 1)[1][:-4]), r.y, r.x): (r.b, r.g, r.r) for r in images.to_px(read).collect()}
    assert back == {(r.image_id, r.y, r.x): (r.l, r.l, r.l) for r in px.collect()}


def test_files_on_disk_give_their_metrics(spark, tmp_path):
    px = fixtures.drawings(spark, SF).where("image_id <= 3").cache()
    images.write_files(images.encode(px), str(tmp_path)).collect()
    read = images.gray_rasters(images.read_images(spark, str(tmp_path)))
    names = lambda df: {(str(r.image_id).rsplit("/", 1)[-1].removesuffix(".png"), *tuple(r)[1:]) for r in df.collect()}
    assert names(read.select("image_id", "width", "height").distinct()) == names(px.select("image_id", "width", "height").distinct())
    for metric in (metrics.basic_metrics, metrics.box_contrast, metrics.sobel_edges):
        found = names(metric(read))
        assert found == names(metric(px)) and len(found) == 4


def test_alpha_is_real_only_if_something_is_transparent(spark, tmp_path):
    def rgba(alpha):
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        lines = b"".join(b"\0" + bytes([10, 20, 30, a]) * 3 for a in alpha)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, len(alpha), 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(rgba([255, 255]))
    (tmp_path / "b.png").write_bytes(rgba([255, 128]))
    read = images.read_images(spark, str(tmp_path))
    assert {r.origin[-5]: (r.has_alpha, r.has_real_alpha) for r in read.collect()} == {"a": (True, False), "b": (True, True)}
    assert {(r.b, r.g, r.r) for r in images.to_px(read).collect()} == {(30, 20, 10)}


def test_listing_and_manifest(spark, tmp_path):
    for name, body in (("x.PNG", b"1"), ("y.jpeg", b"22"), ("z.txt", b"3")):
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "w.png").write_bytes(b"4")
    found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in images.list_images(spark, str(tmp_path)).collect()}
    assert found == {"x.PNG": (1, hashlib.sha256(b"1").hexdigest()), "y.jpeg": (2, hashlib.sha256(b"22").hexdigest())}
    manifest = tmp_path / "m.csv"
    manifest.write_text("name;title \n a ; one\nb;\n")
    assert [tuple(r) for r in images.read_manifest(spark, str(manifest), ";").collect()] == [("a", "one"), ("b", "")]
