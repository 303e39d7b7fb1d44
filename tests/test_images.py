"""Kernels, codecs, sources, the measuring stage and the stream, on images made here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegauge.functions import kernels as k
from pagegauge.operators import detect, measure, report, rules
from pagegauge.plans import catalogue
from pagegauge.plans.config import Settings
from pagegauge.sources import codecs, files, pdf, sinks
from pagegauge.streaming import ingest


def sheet(height=1000, width=700, words=True, seed=1):
    """Cream paper with rows of grey words of random lengths, wide margins all around."""
    out = np.full((height, width, 3), (232, 240, 243), np.uint8)
    rng = np.random.default_rng(seed)
    for y in range(height // 10, height * 9 // 10, 28) if words else ():
        x = width // 8
        while x < width * 7 // 8:
            n = int(rng.integers(18, 90))
            out[y : y + 9, x : min(x + n, width * 7 // 8)] = 64
            x += n + 14
    return out


def on_table(paper=None, height=1400, width=1000, at=(200, 150), table=38):
    """Paper laid on a table whose grain runs across; what lies outside the picture is cut off."""
    grain = (table + 6 * np.cos(np.arange(height) / 23.0)).astype(np.uint8)
    out = np.repeat(np.repeat(grain[:, None, None], width, axis=1), 3, axis=2)
    paper = sheet() if paper is None else paper
    y, x = at
    part = paper[: height - y, : width - x]
    out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def tilted(angle):
    """Written paper turned counter-clockwise about its middle."""
    return k.turned(k.gray(sheet(900, 900)), angle, enlarge=False)


CORNERS = np.array([[150, 200], [849, 200], [849, 1199], [150, 1199]], float)


def codes(image, **settings):
    rows = measure.measure_file("f.png", codecs.encode_png(image), measure.Pipeline(settings=Settings(detector="mask-contour", **settings), keep_images=False))
    return rows


def test_png_and_bmp():
    image = np.random.default_rng(0).integers(0, 256, (13, 17, 3), dtype=np.uint8)
    assert (codecs.decode(codecs.encode_png(image)) == image).all()
    for junk in (b"", b"\x00\x01\x02not-an-image" * 8, codecs.encode_png(image)[:-20]):
        with pytest.raises(codecs.DecodeError):
            codecs.decode(junk)


@pytest.mark.parametrize("angle", [0, 3, 10, -12, 24])
def test_text_skew(angle):
    # what a page was turned by counter-clockwise is turned back by the angle read
    assert abs(k.text_skew(tilted(angle)) + angle) <= 1.0
    assert k.text_skew(np.full((400, 300), 250, np.uint8)) is None


def test_deskew_levels_the_page():
    askew = tilted(6)
    assert abs(k.text_skew(k.turned(askew, k.text_skew(askew, 0.5)), 0.5)) <= 1.0


def test_measures_move_as_they_should():
    sharp = sheet()
    assert k.blur_score(k.gaussian(k.gray(sharp), 31).astype(np.uint8)) < k.blur_score(sharp)
    assert k.glare_ratio(np.full((10, 10), 250, np.uint8)) == 1.0
    assert abs(k.median_brightness(sheet()) - 240) <= 2


def test_components_and_rectangle():
    m = np.zeros((20, 30), bool)
    m[2:6, 2:8] = m[6:9, 8:12] = m[15:18, 20:28] = True
    assert len(np.unique(k.components(m))) == 3
    assert k.largest(m).sum() == 24 + 12
    box = k.least_rectangle(np.array([[0, 0], [10, 0], [10, 5], [0, 5], [4, 2]]))
    assert abs(measure._area(box) - 50) < 1e-6


def test_iou_and_warp():
    q = np.array([[10, 10], [90, 10], [90, 60], [10, 60]], float)
    assert k.iou(q, q, 100, 120) == 1.0
    assert k.flatten(on_table(), CORNERS).shape[:2] == (999, 699)


def test_clean_page_is_found():
    (row,) = codes(on_table())
    assert row["has_quad"] and row["is_convex"] and 0.4 < row["quad_area_ratio"] < 0.6
    assert row["touches_border"] == 0 and row["border_ink_ratio"] == 0.0


def test_edges_find_it_too():
    work = k.resized(on_table(), 500)
    (quad, confidence), *_ = k.edge_quad(work)
    assert confidence == 0.5
    assert k.iou(quad, np.array([[53, 71], [303, 71], [303, 428], [53, 428]], float), *work.shape[:2]) > 0.9


def plain_ink(image, quad, band, margin=2):
    """The share of ink along each side that the page lies flush with, pixel by pixel."""
    g = k.gray(image)
    h, w = g.shape
    page = k.fill(quad, h, w)
    paper, ink, reach = k.paper_mask(g, page), k.ink_mask(g), max(3, round(0.01 * min(h, w)))
    out = 0.0
    for turn in range(4):  # each side in turn as the top one
        p, q, i = (np.rot90(m, turn) for m in (page, paper, ink))
        flush = p[: margin + 1].any(0)
        if flush.mean() < 0.1:
            continue
        found = total = 0
        for y in range(band):
            for x in np.flatnonzero(flush):
                if q[y, x] and p[y, max(0, x - reach) : x + reach + 1].all():
                    total += 1
                    found += i[y, x]
        out = max(out, found / total if total else 0.0)
    return out


def test_ink_at_the_frame():
    paper = sheet(1100, 820)
    paper[:60, 100:400] = np.where(np.arange(300)[None, :, None] % 40 < 20, 60, paper[:60, 100:400])
    cut = on_table(paper, 1200, 900, (0, 0))
    whole = np.array([[0, 0], [819, 0], [819, 1099], [0, 1099]], float)
    aslant = np.array([[300, 0], [899, 120], [700, 1099], [0, 700]], float)
    for quad in (whole, aslant):
        assert abs(k.ink_at_border(cut, quad) - plain_ink(cut, quad, 9)) < 1e-9
    assert k.ink_at_border(cut, whole) > 0.08
    assert k.ink_at_border(on_table(), CORNERS) == 0.0


def test_what_the_cut_leaves_out():
    """Half of a written page outside the quad, held against the edges of the whole quad at 50 and 150."""
    work = k.resized(on_table(), 500)
    mask = k.bright_mask(work)
    ys, xs = np.nonzero(mask)
    half = np.array([[xs.min(), ys.min()], [xs.max(), ys.min()], [xs.max(), (ys.min() + ys.max()) // 2], [xs.min(), (ys.min() + ys.max()) // 2]], float)
    share, structure = k.content_outside(work, half, mask)
    lines, inside = k.edges(k.gray(work), 50, 150), k.fill(half, *mask.shape)
    n = max(3, round(0.06 * min(mask.shape))) | 1
    part = k.largest(k.eroded(mask & ~inside, n, n))
    assert 0.2 < share < 0.5 and share == part.sum() / mask.sum()
    assert abs(structure - lines[part].mean() / lines[inside].mean()) < 1e-9 and structure > 0.1
    whole = np.array([[xs.min(), ys.min()], [xs.max(), ys.min()], [xs.max(), ys.max()], [xs.min(), ys.max()]], float)
    assert k.content_outside(work, whole, mask)[0] < 0.02
    assert k.content_outside(work, whole, None) == (None, None)
    assert k.content_outside(work, whole, np.zeros_like(mask)) == (0.0, 0.0)


def test_a_dented_outline_has_no_four_corners():
    mask = np.zeros((200, 150), bool)
    mask[20:180, 20:130] = True
    (corners, sure), = k.mask_quads(mask)
    assert sure == 0.9 and k.iou(corners, np.array([[20, 20], [129, 20], [129, 179], [20, 179]], float), 200, 150) > 0.98
    mask[80:120, 60:130] = False
    assert [sure for _, sure in k.mask_quads(mask)] == [0.6]
    ring = k.contour(mask)
    assert len(ring) == len({tuple(p) for p in ring}) and {tuple(p) for p in ring} <= {(x, y) for y, x in zip(*np.nonzero(mask))}
    assert len(k.contour(np.eye(3, dtype=bool))) == 4 and len(k.contour(np.array([[False, True]]))) == 1


def test_pushed_out_corners():
    (near,), (far,) = codes(on_table()), codes(on_table(), edge_expand_px=10)
    area = lambda r: measure._area(np.array([[c["x"], c["y"]] for c in r["corners"]]))
    assert area(far) > area(near)


def test_a_scorer_is_loaded_once(tmp_path):
    loads = []

    def load(path, providers, gpu):
        loads.append(path)
        maps = np.zeros((1, 4, 64, 64), np.float32)
        for n, (y, x) in enumerate([(10, 10), (10, 50), (50, 50), (50, 10)]):
            maps[0, n, y, x] = 0.9
        return lambda batch: [maps] if batch.shape == (1, 3, 256, 256) and batch.max() <= 1 else []

    s = Settings(corner_model=str(tmp_path / "some.onnx"))
    for _ in range(3):
        (quad, sure), = measure.regressed(on_table(), s, load)
    assert len(loads) == 1 and abs(sure - 0.9) < 1e-6 and quad.shape == (4, 2)
    with pytest.raises(measure.ModelMissing):
        measure.regressed(on_table(), s)


def test_growing_quad_and_heat_maps():
    q = np.array([[20, 20], [80, 20], [80, 80], [20, 80]], float)
    grown = k.containing_quad(q, np.array([[x, y] for x in range(15, 86) for y in (15, 85)], float), 100, 100)
    assert measure._area(grown) > measure._area(q)
    maps = np.zeros((4, 16, 16))
    for m, (y, x) in zip(maps, [(2, 2), (2, 13), (13, 13), (13, 2)], strict=True):
        m[y, x] = 0.8
    corners, confidence = k.heatmap_corners(maps, 160, 160)
    assert confidence == 0.8 and tuple(corners[0]) == (20, 20)
    assert k.heatmap_corners(np.zeros((4, 8, 8)), 10, 10) is None


def test_missing_model_is_a_row():
    (row,) = measure.measure_file("f", codecs.encode_png(on_table()), measure.Pipeline(settings=Settings()))
    assert row["error"] == "MODEL_MISSING"
    with pytest.raises(KeyError):
        detect.get("nothing")


def test_pdf_round_trip():
    data = pdf.write([on_table(sheet(100, 70), 140, 100, (20, 15)), None, k.gray(sheet(50, 40))])
    pages = list(pdf.read_pages(b"junk" * 30 + data))
    assert [p[0] for p in pages] == [1, 2] and pages[0][1].shape == (140, 100, 3)
    for bad, code in ((b"%PDF-1.7 junk", "PDF_DECODE_FAILED"), (b"none", "PDF_DECODE_FAILED")):
        with pytest.raises(pdf.PdfError) as e:
            list(pdf.read_pages(bad))
        assert e.value.code == code
    with pytest.raises(pdf.PdfError) as e:
        list(pdf.read_pages(data, Settings(pdf_max_pages=1)))
    assert e.value.code == "PDF_TOO_MANY_PAGES"
    with pytest.raises(pdf.PdfError):
        pdf.write([None])


def test_files_to_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = tmp_path / "in"
    (at / "good.png").write_bytes(codecs.encode_png(on_table()))
    (at / "empty.png").write_bytes(b"")
    (at / "junk.jpg").write_bytes(b"\x00\x01\x02not-an-image")
    (at / "two.pdf").write_bytes(pdf.write([on_table(), on_table()]))
    (at / "note.txt").write_text("x")
    rows = measure.judged(files.contents(spark, str(at))).cache()
    got = {(r["file"].rsplit("/", 1)[1], r["page"]): (r["verdict"], list(r["reasons"])) for r in rows.collect()}
    assert set(got) == {("good.png", 1), ("empty.png", None), ("junk.jpg", None), ("two.pdf", 1), ("two.pdf", 2)}
    assert got["empty.png", None] == ("fail", ["FILE_EMPTY"]) and got["junk.jpg", None] == ("fail", ["DECODE_FAILED"])
    sinks.report_csv(rows, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 5
    assert sorted(r["name"].rsplit("/", 1)[1] for r in sinks.page_files(rows).collect()) == ["good.png.out.png", "two.pdf.p1.out.png", "two.pdf.p2.out.png"]
    assert {r["file"].rsplit("/", 1)[1]: len(list(pdf.read_pages(bytes(r["pdf"])))) for r in sinks.documents_pdf(rows).collect()} == {"good.png": 1, "two.pdf": 2}
    told = {r["file"].rsplit("/", 1)[1]: r["told"] for r in rows.collect() if r["page"] is None}
    assert [(t["code"], t["severity"], t["audience"]) for t in told["empty.png"]] == [("FILE_EMPTY", "fail", "capturer")]
    assert told["junk.jpg"][0]["hint"] and told["junk.jpg"][0]["detail"]
    sinks.write_files(sinks.page_files(rows).withColumn("name", F.element_at(F.split("name", "/"), -1)), str(tmp_path / "pages"))
    for _ in range(2):  # again, and nothing changes
        sinks.write_files(sinks.page_files(rows).withColumn("name", F.element_at(F.split("name", "/"), -1)), (tmp_path / "pages").as_uri())
    assert sorted(x.name for x in (tmp_path / "pages").iterdir()) == ["good.png.out.png", "two.pdf.p1.out.png", "two.pdf.p2.out.png"]
    assert codecs.decode((tmp_path / "pages" / "good.png.out.png").read_bytes()).ndim == 3
    texts = {r["file"].rsplit("/", 1)[1]: json.loads(r["document"]) for r in report.documents_json(rows).collect()}
    assert texts["two.pdf"]["page_count"] == 2 and [p["page"] for p in texts["two.pdf"]["pages"]] == [1, 2]
    assert texts["empty.png"]["verdict"] == "fail" and texts["empty.png"]["reasons"] == ["FILE_EMPTY"]
    rows.unpersist()


def test_details_tell_figures(spark):
    row = spark.createDataFrame([(["BLURRY", "CLIPPED_EDGE", "FALLBACK_ORIGINAL"], 12.34567, 2)], "reasons array<string>, blur_score double, touches_border int")
    for audience in ("capturer", "operator"):
        told = row.select(rules.told(F.col("reasons"), Settings(hint_audience=audience), row.columns).alias("t"), rules.first_failing(F.col("reasons")).alias("f")).first()
        assert [t["detail"] for t in told["t"]] == ["blur_score 12.3457, limit 25", "touches_border 2.0", None]
        for t in told["t"]:
            _, capturer, operator = catalogue.TEXTS[t["code"]]
            assert t["severity"] == catalogue.SEVERITY[t["code"]] and t["hint"] == ((capturer or operator) if audience == "capturer" else operator)
        assert told["f"] == next((t["code"] for t in told["t"] if t["severity"] == "fail"), None)


def test_labels_and_truth(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"file": "a", "expect_verdict": "pass"}\n\n{"file": "a", "expect_verdict": "fail"}\n')
    assert [(r["file"], r["expect_verdict"]) for r in files.labels(spark, str(tmp_path / "l.jsonl")).collect()] == [("a", "fail")]
    point = lambda n, x, y: f'<point name="{n}" x="{x}" y="{y}"/>'
    whole = point("bl", 10.5, 90.5) + point("tl", 11, 20) + point("tr", 80, 21) + point("br", 81.5, 91)
    (tmp_path / "t.xml").write_text(f'<s><frame index="1" rejected="false">{whole}</frame><frame index="2" rejected="True">{whole}</frame><frame index="3" rejected="false">{point("tl", 1, 1)}</frame></s>')
    rows = files.ground_truth(spark, str(tmp_path / "t.xml")).collect()
    assert [(r["index"], [(p["x"], p["y"]) for p in r["corners"]]) for r in rows] == [(1, [(11, 20), (80, 21), (81.5, 91), (10.5, 90.5)])]


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.png").write_bytes(codecs.encode_png(on_table()))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n + 1


def test_settings():
    s = Settings.from_env({"PAGEGAUGE_DESKEW": "no", "PAGEGAUGE_WORK_HEIGHT": "300", "PAGEGAUGE_GLARE_RATIO": "0.5"}, work_height=None, detector="edge-hough")
    assert (s.deskew, s.work_height, s.glare_ratio, s.detector) == (False, 300, 0.5, "edge-hough")
    with pytest.raises(TypeError):
        Settings.from_env({}, nothing=1)
