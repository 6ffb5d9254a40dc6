"""The reference's operators: hand-made frames, files and records, and every query against its SQL."""

import itertools
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasgrain.functions import colour, text
from atlasgrain.operators import contracts, frames, integrity, kernels, mattes, pixels, poses, segmentation, sequences, transforms, video
from atlasgrain.plans import catalog
from atlasgrain.sources import documents, gif
from atlasgrain.sources import frames as source

DATA = "/root/testdata/sf0.001"


def frame(spark, *images):
    """Packed frames of (alpha rectangle list, side) images; white where solid."""
    rows = []
    for k, (rects, side) in enumerate(images):
        a = np.zeros((side, side), int)
        for x0, y0, x1, y1 in rects:
            a[y0 : y1 + 1, x0 : x1 + 1] = 255
        rows.append((k, 0, k, side, side, *[a.ravel().tolist()] * 4))
    return spark.createDataFrame(rows, "image_id long, seq int, fidx int, w int, h int, r array<int>, g array<int>, b array<int>, a array<int>")


def test_bounds_and_contacts(spark):
    px = frame(spark, ([(7, 5, 24, 28)], 32), ([(0, 5, 24, 31)], 32), ([], 32))
    out = {r.image_id: r for r in frames.measure_frame(px).collect()}
    assert (out[0].x0, out[0].y0, out[0].x1, out[0].y1, out[0].contact) == (7, 5, 25, 29, 0)
    assert out[1].contact == 27 + 24 and out[1].largest_ratio == 1.0
    assert out[2].opaque == 0 and out[2].x0 is None and out[2].largest == 0 and out[2].bbox_ratio == 0.0


def test_validate_blank_clipped_scattered(spark):
    px = frame(spark, ([], 8), ([(0, 0, 4, 4)], 8), ([(2, 2, 4, 4)], 8), ([(1, 1, 2, 2), (5, 5, 6, 6)], 8), ([(1, 1, 1, 1)], 8))
    out = {r.image_id: r for r in frames.validate_frame(frames.measure_frame(px)).collect()}
    assert [out[k].failures for k in range(5)] == ["blank", "edge", "", "", "opaque-share,box-share"]
    assert [out[k].scattered for k in range(5)] == [False, False, False, True, False] and out[2].profile == "tiny-8x8"


def test_margin_and_band_take_corners_as_said(spark):
    out = frames.edge_measures(frame(spark, ([(1, 8, 14, 20)], 32), ([(0, 0, 0, 0)], 8))).orderBy("image_id").collect()
    assert out[0].outside == 13 and out[0].band == 13
    assert out[1].outside == 1 and out[1].band == 2  # a corner lies in two strips


def test_components_connectivity(spark):
    px = frame(spark, ([(0, 0, 0, 0), (1, 1, 1, 1), (3, 0, 4, 1)], 6))
    assert [(r.ord, r.area) for r in frames.components(px).orderBy("ord").collect()] == [(1, 1), (2, 4), (3, 1)]
    assert frames.measure_frame(px).first().largest == 4
    assert [(r.ord, r.area) for r in frames.components(px, steps=kernels.EIGHT).orderBy("ord").collect()] == [(1, 2), (2, 4)]


def test_frames_of_which_no_part_is_kept(spark, sql, tmp_path):
    """Single pixels, all of them under the least area, against the SQL: a row without a box."""
    solid = ([], [0], [9, 27, 63], [0, 1, 40], [18, 19, 26, 27])
    vectors = [(k, [0.5 if i in on else -0.5 for i in range(64)], 0) for k, on in enumerate(solid)]
    table = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(table)
    got = {r.image_id: tuple(r)[1:] for r in catalog.QUERIES["components_kept"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1, None, None, None, None, ""), 2: (0, 3, None, None, None, None, ""), 3: (1, 1, 0, 0, 2, 1, "left,top"), 4: (1, 0, 2, 2, 4, 4, "")}
    con = sql.cursor()
    con.execute("create schema odd")
    con.execute(f"create view odd.embeddings as select * from '{table}/*.parquet'")
    con.execute("set schema = 'odd'")
    assert {r[0]: r[1:] for r in con.execute(catalog.ORACLES["components_kept"]).fetchall()} == got


def test_kernels():
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    ring[2, 2] = True
    assert kernels.exterior(ring).sum() == 16
    one = np.zeros((5, 5), bool)
    one[2, 2] = True
    assert kernels.dilate(one).sum() == 9 and kernels.dilate(one, 2).sum() == 25
    assert kernels.cheapest_cuts([5, 5, 0, 5, 5, 0, 5, 5], 0, 8, 3) == [2, 5]


def flood(mask, steps):
    """Components pixel by pixel, in raster order."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                v, u = todo.pop()
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                    out[v, u] = n
                    todo += [(v + dy, u + dx) for dy, dx in steps]
    return out


def test_labels_against_a_flood():
    r = np.random.default_rng(1)
    for k in range(60):
        mask = r.random((r.integers(1, 14), r.integers(1, 14))) < (0.3, 0.5, 0.7)[k % 3]
        for steps in (kernels.FOUR, kernels.EIGHT):
            assert (kernels.label(mask, steps) == flood(mask, steps)).all()


def test_cuts_against_all_choices():
    r = np.random.default_rng(2)
    for _ in range(60):
        n, parts = int(r.integers(4, 15)), int(r.integers(2, 5))
        v, even = r.integers(0, 9, n).tolist(), n / parts
        least = max(2, int(even * 0.45))
        fits = [c for c in itertools.combinations(range(1, n), parts - 1) if all(b - a >= least for a, b in zip((0, *c), (*c, n), strict=True))]
        cost = lambda c: sum(v[x] for x in c) + sum(0.0015 * (b - a - even) ** 2 for a, b in zip((0, *c), (*c, n), strict=True))  # noqa: E731, B023
        got = kernels.cheapest_cuts(v, 0, n, parts)
        assert (cost(got) == pytest.approx(min(map(cost, fits)))) if fits else got == []


def sprite(*boxes, size=(220, 140)):
    p = np.zeros((size[1], size[0], 4), int)
    for x0, y0, x1, y1 in boxes:
        p[y0 : y1 + 1, x0 : x1 + 1] = 255
    return p


def test_spans_of_strips():
    three = sprite((5, 10, 44, 54), (80, 5, 124, 57), (160, 5, 199, 90))
    spans, report = segmentation.projection_spans(three, 3)
    assert len(spans) == 3 and report == {"ok": True, "natural": 3, "forced": False, "warning": ""}
    one = sprite((10, 10, 209, 60))
    spans, report = segmentation.projection_spans(one, 4)
    assert len(spans) == 4 and report["forced"] and report["natural"] == 1 and report["ok"] and report["warning"] == "count"
    assert segmentation.projection_spans(sprite(), 2)[1]["warning"] == "no content" and segmentation.projection_spans(one, 0)[1]["warning"] == "expected"
    bands = segmentation.grid_projection(np.concatenate([three, one]), 3, 2)
    assert [(b["top"], b["bottom"], b["warning"]) for b in bands] == [(0, 140, ""), (140, 280, "count")]
    assert segmentation.pose_peaks(np.array([0, 5, 1]), 0, 2) == [1] and segmentation.pose_peaks(np.array([3, 3, 3, 3]), 0, 4) == [2]


def test_auto_layout_merges_and_clusters():
    p = sprite((5, 5, 44, 54), (80, 8, 124, 57), (48, 20, 52, 40), (10, 80, 50, 130))
    rows = segmentation.auto_layout(p)
    assert [[(b[0], b[2]) for b in row] for row in rows] == [[(5, 53), (80, 125)], [(10, 51)]]


def test_affine_maps_back():
    p = np.arange(64 * 4).reshape(8, 8, 4)
    assert (transforms.affine(p, {}, (8, 8)) == p).all() and (transforms.affine(p, {"flipX": 1}, (8, 8)) == p[:, ::-1]).all()
    assert (transforms.affine(p, {"rotate": 90}, (8, 8)) == np.rot90(p)).all()
    assert (transforms.affine(p + 1, {"scale": 2.0}, (8, 8)) > 0).all()  # no holes
    assert (transforms.affine(p, {"dx": 2, "dy": 1}, (8, 8))[1:, 2:] == p[:-1, :-2]).all()
    flat = transforms.affine_inverse({"scale": 0.0}, (8, 8), (8, 8))
    assert all(np.isfinite(flat))


def slow_resize(p, w, h, name):
    """The same filter, one target pixel at a time."""
    reach, weight = transforms.FILTERS[name]

    def line(values, new):
        old, out = len(values), []
        ratio, wide = old / new, max(1.0, old / new)
        for t in range(new):
            c = (t + 0.5) * ratio
            near = range(max(0, math.floor(c - reach * wide + 0.5)), min(old, math.floor(c + reach * wide + 0.5)))
            k = [float(weight(np.array((i - c + 0.5) / wide))) for i in near]
            out.append(min(255, max(0, math.floor(sum(a * values[i] for a, i in zip(k, near, strict=True)) / sum(k) + 0.5))))
        return out

    planes = [np.floor(p[..., c] * p[..., 3] / 255 + 0.5) if c < 3 else p[..., 3] for c in range(4)]
    planes = [np.array([line(r, w) for r in x.tolist()]) for x in planes]
    planes = [np.array([line(r, h) for r in x.T.tolist()]).T for x in planes]
    a = planes[3]
    return np.stack([np.where(a > 0, np.minimum(255, 255 * x // np.maximum(a, 1)), 0) for x in planes[:3]] + [a], axis=2)


def test_resizing():
    p = np.random.default_rng(3).integers(0, 256, (7, 9, 4))
    assert np.abs(transforms.resize(p, 4, 5) - slow_resize(p, 4, 5, "lanczos")).max() <= 1 and np.abs(transforms.resize(p, 12, 8) - slow_resize(p, 12, 8, "bicubic")).max() <= 1
    flat = np.full((6, 6, 4), 200)
    assert (transforms.resize(flat, 4, 3)[..., 3] == 200).all() and np.abs(transforms.resize(flat, 13, 9)[..., :3] - 200).max() <= 1
    assert transforms.resize(p, 18, 14, pixel_art=True, whole_scale=True).shape == (14, 18, 4)
    with pytest.raises(ValueError, match="ratio"):
        transforms.resize(p, 18, 15, pixel_art=True, whole_scale=True)
    assert transforms.fit_cover(p, 3, 3, True).shape == (3, 3, 4) and transforms.fit_locked(p, 3, 3) is None and (transforms.fit_locked(p, 9, 7) == p).all()


def moving(offsets):
    out = []
    for d in offsets:
        p = np.zeros((32, 32, 4), int)
        p[..., 3] = 255
        p[8:23, 10 + d : 22 + d, :3] = 230
        out.append(video.signature(p))
    return out


def test_adaptive_samples_find_the_extremes():
    hump = [1, 3, 5, 3, 1]
    swing = moving([0] * 3 + [-d for d in hump] + [0] * 3 + hump + [0] * 3)
    best = video.adaptive_sample(swing, 4)[0][1]
    assert best[0] == 0 and 4 <= best[1] <= 6 and 8 <= best[2] <= 10 and 12 <= best[3] <= 14
    wave = moving([round(5 * math.sin(2 * math.pi * k / 36)) for k in range(36)])
    ranked = video.adaptive_sample(wave, 6)
    assert 1 <= len(ranked) <= 8 and all(len(set(c)) == 6 and c == sorted(c) and c[0] == 0 for _, c in ranked)
    assert [m for m, _ in ranked] == sorted([m for m, _ in ranked], reverse=True)
    with pytest.raises(ValueError, match="few"):
        video.adaptive_sample(wave[:17], 6)


def test_slots_by_hand():
    """Each slot takes the greatest of marks that are written out here anew."""
    s = moving([0, 1, 4, 2, 5, -3, 0, 2, -5, 4, 1, 0, 3, -2, 5, 0, 1, -4])
    v = video.Poses(s)
    for shift, novelty, anchor in video.VARIANTS:
        window, chosen, total = max(2, 18 // 12), [0], 0.0
        for slot in range(1, 6):
            target = slot * 18 / 6 + shift * window
            low, high = max(chosen[-1] + 1, round(target - window)), min(17, round(target + window), 17 - (6 - slot - 1))
            if low > high:
                break
            mark = {k: novelty * video.distance(s[chosen[-1]], s[k]) + anchor * video.distance(s[0], s[k]) + 0.12 * v.calm[k] + 0.08 * (1 - min(1, abs(k - target) / window)) - 2.0 * (s[k].border > 0) for k in range(low, high + 1)}
            best = max(mark, key=mark.get)
            total, chosen = total + mark[best], [*chosen, best]
        if len(chosen) == 6:
            assert any(c == chosen and m == pytest.approx(total) for m, c in video.slot_choices(v, 6))


def wandering(spark, n, seqs=2, side=8):
    """Packed frames of several sequences of one length, in no order, with gaps in fidx."""
    r = np.random.default_rng(5)
    videos = {q: [np.where(r.random((side, side, 4)) < 0.5, r.integers(0, 256, (side, side, 4)), 0) for _ in range(n)] for q in range(seqs)}
    rows = [(1000 * q + k, q, 3 * k + 1, side, side, *[p[..., c].ravel().tolist() for c in range(4)]) for q, v in videos.items() for k, p in enumerate(v)]
    r.shuffle(rows)
    kinds = "image_id long, seq int, fidx int, w int, h int, r array<int>, g array<int>, b array<int>, a array<int>"
    return videos, spark.createDataFrame([(int(i), int(q), int(k), *x) for i, q, k, *x in rows], kinds)


@pytest.mark.parametrize("side", [8, 72])
def test_dealt_signatures_against_whole_videos(spark, side):
    """Frames dealt over tasks have the signatures of a video held as a whole, bit by bit."""
    videos, packed = wandering(spark, 29, side=side)
    seen = {q: [video.signature(p) for p in v] for q, v in videos.items()}
    want = {(q, k): (*(getattr(x, m) for m in video.MEASURES), video.distance(s[0], x)) for q, s in seen.items() for k, x in enumerate(s)}
    assert {(r.seq, r.fidx): tuple(r)[2:] for r in video.signatures(packed).collect()} == want
    small = {(r.cw, r.ch, len(r.cells)) for r in video.signatures(packed, pictures=True).collect()}
    assert small == {(min(side, 64), min(side, 64), 3 * min(side, 64) ** 2)}


def test_a_sequence_is_not_one_task_of_signatures(spark, tmp_path):
    """One sequence of 200 frames: no task has them all."""
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(0, 63), i -> cast(sin(id + i) as float))").alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = catalog.QUERIES["video_signature"](spark, str(tmp_path)).select("fidx", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r.fidx for r in got) == list(range(200))
    assert max(sum(r.task == t for r in got) for t in {r.task for r in got}) < 150


def test_frames_of_a_sequence_are_made_when_asked_for():
    v = video.Video(np.array([2, 1]), np.array([1, 2]), [(np.arange(4), np.array([0, 2, 4]))] * 2, np.array([1, 0]))
    assert [p.shape for p in v] == [(2, 1, 2), (1, 2, 2)] and v[0].ravel().tolist() == [2, 2, 3, 3] and len(v[1:]) == 1


@pytest.mark.parametrize("side", [8, 72])
def test_choices_without_pictures_against_whole_videos(spark, side):
    """Pictures made anew where they are compared give the choices of a video held as a whole, bit by bit."""
    videos, packed = wandering(spark, 29, side=side)
    seen = {q: [video.signature(p) for p in v] for q, v in videos.items()}
    want = {(q, n, k + 1): (",".join(map(str, c)), round(m, 6)) for q, s in seen.items() for n in (6, 4) for k, (m, c) in enumerate(video.adaptive_sample(s, n))}
    assert {(r.seq, r.wanted, r.rank): (r.frames, r.score) for r in video.adaptive_samples(packed).collect()} == want


def test_choices_hold_no_pictures(spark):
    """600 frames, whose pictures are 61 MB: their choices take a few."""
    import tracemalloc

    _, packed = wandering(spark, 600, seqs=1)
    table = video.signatures(packed, pictures=True).toArrow()
    tracemalloc.start()
    try:
        assert video.chosen_of(table, (6, 4)).num_rows > 2
        assert tracemalloc.get_traced_memory()[1] < 6e6
    finally:
        tracemalloc.stop()


def test_signature():
    p = np.zeros((64, 64, 4), int)
    p[10:50, 20:40, :3] = 200
    s = video.signature(p)
    assert (s.width, s.height, s.core_height, s.border) == (20 / 64, 40 / 64, 40 / 64, 0.0) and s.area == 800 / 4096
    assert s.center_x == pytest.approx(29.5 / 63) and video.distance(s, s) == 0


def test_repeat_bounds_of_a_period():
    x = np.arange(64)
    p = np.zeros((16, 64, 4), int)
    p[..., :3] = (127 + 120 * np.sin(2 * np.pi * x / 20))[None, :, None].astype(int)
    found = video.repeat_bounds(p, 0.2)
    assert (found["end_frame"] - found["start_frame"]) % 20 == 0 and found["error"] < 0.02
    dark = video.repeat_bounds(p, 0.2, dark=True)
    assert dark["light"] <= found["light"]


def test_edge_palette_by_hand():
    p = np.zeros((4, 4, 4), int)
    p[..., 3] = 255
    p[0, :, 0], p[3, :3, 1], p[1:3, 1:3, 2] = 200, 180, 250
    assert pixels.border_palette(p) == [(0, 0, 0), (200, 0, 0), (0, 180, 0)]
    p[1, 0, :3] = (190, 0, 0)
    assert (190, 0, 0) not in pixels.border_palette(p) and pixels.border_palette(p, most=1) == [(200, 0, 0)]


def test_restored_regions():
    source_ = np.zeros((40, 40, 4), int)
    source_[..., 3] = 255
    source_[5:25, 5:25, :3] = 220
    source_[30:38, 30:38, :3] = 220
    cut = source_.copy()
    cut[..., 3] = 0
    cut[5:9, 5:25, 3] = 255
    out, n = mattes.restore_regions(source_, cut, [(0, 0, 0)])
    assert n == 16 * 20 and out[20, 20, 3] == 255 and out[34, 34, 3] == 0 and out[0, 0, 3] == 0
    assert mattes.restore_regions(source_, cut, [(0, 0, 0)], detached=True)[1] == 16 * 20 + 64
    assert mattes.restore_regions(source_, cut, [(0, 0, 0)], least=401)[1] == 0 and mattes.restore_regions(source_, cut, [])[1] == 0


def figure(offsets, lift=0, head=20):
    """A drawn figure, 200 x 200: ground line, grey torso, pale head, four coloured limbs moved across by ``offsets``."""
    p = np.full((200, 200, 4), 255)
    p[180:183, :, :3] = 0
    p[70:120, 85:115, :3] = 100
    p[35 : 35 + head, 90 : 90 + head, :3] = 200
    colours = {"red_arm": (220, 30, 30), "blue_arm": (30, 60, 220), "orange_leg": (240, 140, 20), "green_leg": (30, 180, 60)}
    for limb, (c, d) in {k: (c, d) for (k, c), d in zip(colours.items(), offsets, strict=True)}.items():
        y0, y1 = (75, 115) if "arm" in limb else (122, 179 - (lift if limb == "green_leg" else 0))
        p[y0:y1, 95 + d : 103 + d, :3] = c
    return p


def test_limb_gate_on_drawn_figures():
    swing = [30, 18, 4, -28, -16, -4]
    video = [figure((-d - 2, d + 2, d, -d - 9), lift=20 if k == 2 else 0) for k, d in enumerate(swing)]
    errors, paths = poses.limb_gate(video)
    assert errors == [] and set(paths) == set(poses.LIMBS) and all(x["x_range"] > 0.055 for x in paths.values())
    still, _ = poses.limb_gate([figure((-20, 20, 10, -12))] * 6)
    assert {"static", "red_arm: frozen", "green_leg: idle"} <= set(still)
    video[3] = figure((20, -20, -28, 20), head=28)
    assert {"head width drifts", "head height drifts"} <= set(poses.limb_gate(video)[0])
    video[2][video[2][..., 0] == 240] = 255
    assert any("3: no orange_leg" in e for e in poses.limb_gate(video)[0])
    walked, _ = poses.limb_gate([figure((-d - 2, d + 2, d, -d - 9)) for d in swing], walk=True)
    assert "3: green_leg too low" in walked and "6: orange_leg too low" in walked and poses.limb_gate(video[:3], walk=True)[0][-1] == "not six frames"


def test_pose_rules():
    crouch = poses.Pose("crouch", 1.0, 1.0, 0.6, 0.8)
    good = [(0, 100 - h, 40, 100) for h in (50, 45, 38, 32, 30)]
    assert poses.inspect_pose(good, crouch, (40, 50), 100) == ([], [])
    assert poses.inspect_pose([(0, 40, 30, 100), *good[1:-1], (0, 60, 20, 110)], crouch, (40, 50), 100)[0] == ["height", "curve", "width", "baseline"]
    assert poses.inspect_pose(good, crouch, None, 100) == ([], ["no-reference"]) and poses.inspect_pose([], crouch, None, 0) == ([], [])
    assert poses.inspect_pose([(0, 50, 40, 100)] * 3, poses.Pose("jump"), (40, 50), 100)[1] == ["flat-jump"]


def test_cycles_of_any_length(spark):
    chain = [(k, (k + 1) % 300) for k in range(300)] + [(1000, 0), (1001, 1000), (400, 400), (500, 501), (501, None), (None, 3)]
    got = {(r.start, r.length) for r in integrity.reference_cycles(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(0, 300), (400, 1)}


def test_gif_and_atlas(spark):
    two = frame(spark, ([(1, 1, 3, 3)], 8), ([(2, 2, 5, 5)], 8))
    a = documents.animations(two, 90).first()
    assert (a.frames, a.delay_ticks, a.transparent) == (2, 9, True) and bytes(a.content)[:6] == b"GIF89a"
    assert gif.gif_report(bytes(a.content))["loop"]
    sheet = documents.atlases(two, 2).first()
    image = source.decode_png(bytes(sheet.content))
    assert image.shape == (8, 16, 4) and image[3, 11, 3] == 255 and [(c.x, c.y) for c in sheet.cells] == [(0, 0), (8, 0)] and sheet.size_bytes == len(sheet.content)


def test_contract_rules(spark):
    rows = [("r", 1, "approved", "human", "a long enough reason here", ["walk: head"], ["walk: head"], [(p, "1") for p in [*contracts.EVIDENCE, "qa/walk-contact.png", "qa/walk-onion.png"]])]
    review = spark.createDataFrame(rows, "run_id string, version int, status string, reviewer string, reason string, covered array<string>, errors array<string>, pins array<struct<path:string,sha:string>>")
    files = spark.createDataFrame([("r", p, "1") for p, _ in rows[0][-1]], "run_id string, path string, sha string")
    assert contracts.waiver_issues(review, files).first().issues == []
    assert contracts.waiver_issues(review, files.where("path <> 'sprite-sheet-alpha.png'")).first().issues == ["changed"]
    worse = review.withColumns({"errors": F.array(F.lit("walk: head"), F.lit("run: tail")), "reason": F.lit("short"), "version": F.lit(None).cast("int")})
    assert contracts.waiver_issues(worse, files).first().issues == ["version", "reason", "errors", "evidence"]
    seen = [("side", "right"), ("back", "center")]
    t = spark.createDataFrame(seen, "view string, facing string")
    assert {tuple(r) for r in contracts.missing_signatures(t).collect()} == set(contracts.SIGNATURES) - set(seen)
    cases = [("a-b", "p" * 40, "r" * 30, "s", "x", ["y"]), ("a-b", "p" * 40, "r" * 30, "s", None, ["y", "x"]), ("A", "", None, "z", "q", ["x", "x"])]
    found = contracts.routing_errors(spark.createDataFrame(cases, "id string, prompt string, rationale string, scope string, selected string, excluded array<string>"), ["x", "y"], ["s"])
    assert sorted(r.errors for r in found.collect()) == [["duplicate"], ["duplicate"], ["id", "prompt", "rationale", "scope", "selected", "excluded"]]
    docs = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '{"b":"x","a":1}'), (3, "[")], "id int, json string")
    assert [r.changed for r in contracts.migrated(docs, "struct<a:int,b:string>").orderBy("id").collect()] == [False, True, None]
    bad = spark.range(1).select(contracts.request_errors(F.lit(1), F.lit("sprite-gen-request"), F.lit(None).cast("string"), F.lit("tiles"), F.lit("slots"), F.lit(0)).alias("e")).first().e
    assert bad == ["version", "asset_kind", "states"]
    with pytest.raises(ValueError, match="gate"):
        contracts.gate_policy(spark.range(0).toDF("request_id"), selectors=["no-gate"])


def test_optional_documents_and_presets(spark, tmp_path):
    assert documents.optional_documents(spark, str(tmp_path / "none.json"), "k").count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"kind": "k", "presets": {"a": {"x": 1}, "b": {}}}))
    docs = documents.optional_documents(spark, str(tmp_path / "p.json"), "k")
    assert docs.first().error is None and documents.optional_documents(spark, str(tmp_path / "p.json"), "other").first().error == "kind is not other"
    assert sorted(r.preset for r in documents.presets(docs).collect()) == ["a", "b"]


def test_pair_difference_edges(spark):
    px = frame(spark, ([], 8), ([], 8), ([(0, 0, 7, 7)], 8))
    assert [(r.fidx, r.diff) for r in sequences.pair_diffs(px).orderBy("fidx").collect()] == [(0, 0.0), (1, 1.0), (2, 1.0)]
    assert sequences.pair_diffs(px.where("fidx < 2")).count() == 1  # two frames do not wrap


def test_runs_peaks_and_smoothing():
    v = np.array([0, 200, 300, 0, 0, 20, 0, 130, 90, 130, 0])
    runs = segmentation.content_runs(v, 60, 120, 1)
    assert segmentation.without_minor(v, runs) == [(1, 3), (7, 10)] and segmentation.middle_width(runs) == 3
    assert segmentation.smooth(v, 2)[:3].tolist() == pytest.approx([100, 500 / 3, 500 / 3])
    assert segmentation.pose_peaks(np.array([0, 100, 50, 100, 0, 90, 80, 95, 0]), 0, 9) == [1, 3, 7]


def test_colours(spark):
    px = spark.createDataFrame([(255, 0, 255, 255), (10, 20, 30, 0), (200, 100, 50, 200)], "r int, g int, b int, a int")
    key = (255, 0, 255)
    out = px.select(colour.distance_sq(key).alias("d"), colour.key_tint(key).alias("t"), colour.chroma_candidate(key).alias("c"), colour.limb().alias("l"), colour.soft_alpha(F.lit(150.0), 100.0, 200.0).alias("s")).collect()
    assert [(r.d, r.t, r.c) for r in out] == [(0, 255.0, True), (245**2 + 20**2 + 225**2, 0.0, True), (55**2 + 100**2 + 205**2, 25.0, False)]
    assert out[2].l == "red_arm" and [r.s for r in out] == [128, 0, 100]  # 127.5 goes to even
    c = spark.range(1).select(colour.contrast(colour.luminance(*[F.lit(255)] * 3), colour.luminance(*[F.lit(0)] * 3)).alias("c"), *[x.alias(n) for x, n in zip(colour.hex_rgb(F.lit("#0aFF10")), "rgb", strict=True)]).first()
    assert c.c == pytest.approx(21.0) and (c.r, c.g, c.b) == (10, 255, 16)


def test_text(spark):
    rows = [("a/b.png", None), ("/a", "absolute"), ("a//b", "segment"), ("a/../b", "segment"), ("a\\b", "backslash"), ("x/CON.txt", "device"), ("a./b", "ending"), ("", "empty"), (None, "empty"), ("C:a", "absolute"), ("a\x01", "control")]
    got = spark.createDataFrame(rows, "p string, want string").withColumn("got", text.path_problem(F.col("p"))).collect()
    assert [r.got for r in got] == [r.want for r in got]
    t = spark.createDataFrame([("Walk Walk-left, never jump. run",)], "s string").select(text.tokens(F.col("s")).alias("t"), text.positive_tokens(F.col("s")).alias("p"), text.slug(F.col("s")).alias("g"), text.is_slug(text.slug(F.col("s"))).alias("ok"), text.csv_list(F.lit(" a, ,b ")).alias("l")).first()
    assert t.t == ["walk", "left", "never", "jump", "run"] and t.p == ["walk", "left"] and t.g == "walk-walk-left-never-jump-run" and t.ok and t.l == ["a", "b"]


def test_png_round_trip_and_stream(spark, tmp_path):
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (8, 8, 4))
    assert (source.decode_png(source.encode_png(image)) == image).all()
    os.makedirs(tmp_path / "in")
    solid = np.zeros((8, 8, 4), int)
    solid[2:5, 2:5] = 255
    (tmp_path / "in/a.png").write_bytes(source.encode_png(solid))
    (tmp_path / "in/b.png").write_bytes(source.encode_png(solid * 0))
    (tmp_path / "in/c.png").write_bytes(b"no image")
    folder = documents.png_folder(spark, str(tmp_path / "in"))
    assert sorted((x.path[-5:], x.fidx, x.error) for x in folder.collect()) == [("a.png", 0, None), ("b.png", 1, None), ("c.png", None, "not a PNG")]
    again = documents.write_png(folder.where("error IS NULL")).collect()
    assert {x.path[-5:]: bytes(x.content) for x in again}["a.png"] == source.encode_png(solid)
    from atlasgrain.streaming.frames import watch

    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {x.path[-5:]: (x.ok, x.failures, x.error) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.png": (True, "", None), "b.png": (False, "blank", None), "c.png": (False, None, "not a PNG")}


class Caught:
    """Stands for a table, to catch the function that is mapped over its batches."""

    def select(self, *_):
        return self

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_png_batches_are_passed_on_before_they_grow(spark):
    """20 frames of 256 x 256 in one batch: no more than a few are held in Python, and all come out, in order."""
    import tracemalloc

    import pyarrow as pa

    images = [np.full((256, 256, 4), k, np.int32) for k in range(20)]
    names = [f"{k}.png" for k in range(20)]
    side, channel = pa.array([256] * 20, pa.int32()), lambda c: pa.ListArray.from_arrays(pa.array(np.arange(21) * 65536, pa.int32()), np.concatenate([x[..., c].ravel() for x in images]))
    frames_ = pa.RecordBatch.from_arrays([pa.array(names), side, side, *map(channel, range(4))], names=["path", "w", "h", *"rgba"])
    files = pa.RecordBatch.from_arrays([pa.array([*names, "bad.png"]), pa.array([*map(source.encode_png, images), None], pa.binary())], names=["path", "content"])
    written, read = documents.write_png(Caught()).run, source.from_png(Caught()).run
    for run, batch, seen in ((written, frames_, []), (read, files, [])):
        tracemalloc.start()
        for out in run(iter([batch])):
            seen += out.column("path").to_pylist()
            if "content" in out.schema.names:
                assert out.column("content").to_pylist() == files.column("content").slice(len(seen) - out.num_rows, out.num_rows).to_pylist()
            else:
                assert all(a is None or set(a) == {int(p.split(".")[0])} for p, a in zip(out.column("path").to_pylist(), out.column("g").to_pylist(), strict=True))
                assert out.column("error").to_pylist()[-1] == ("not a PNG" if seen[-1] == "bad.png" else None)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert seen == batch.column("path").to_pylist() and peak < 16e6, peak


def test_documents_and_artifacts(spark, tmp_path):
    os.makedirs(tmp_path / "d/walk")
    (tmp_path / "d/a.json").write_text("﻿" + json.dumps({"kind": "sprite"}), encoding="utf-8")
    (tmp_path / "d/b.json").write_text("[1]")
    (tmp_path / "d/c.json").write_text("{")
    out = {r.path[-6:]: r.error for r in documents.json_documents(spark, str(tmp_path / "d/*.json")).select("path", "error").collect()}
    assert out == {"a.json": None, "b.json": "root is not an object", "c.json": "not JSON"}
    declared = spark.createDataFrame([("b.json",), ("gone.json",)], "path string")
    assert {r.path: (r.state, r.size_bytes) for r in documents.artifacts(spark, str(tmp_path / "d"), declared).collect()} == {"b.json": ("present", 3), "gone.json": ("missing", None)}
    assert documents.single_report(spark, str(tmp_path / "d"), "walk").first().error == "found 0"
    (tmp_path / "d/walk/video-source.json").write_text("{}")
    assert documents.single_report(spark, str(tmp_path / "d"), "walk").first().path.endswith("walk/video-source.json")
    cells = spark.createDataFrame([("idle", 1, 2, []), ("run", 0, 1, [(5, 6, 7, 8)])], "state string, row int, frames int, rects array<struct<x:int,y:int,w:int,h:int>>")
    assert sorted((r.state, r.frame, r.x, r.y) for r in documents.manifest_layout(cells, 10, 20).collect()) == [("idle", 0, 0, 20), ("idle", 1, 10, 20), ("run", 0, 5, 6)]
    names = spark.createDataFrame([(1, "idle", 0, None), (1, "run", 1, "x"), (2, "idle", 0, None)], "run int, state string, frame int, label string")
    assert sorted((r.run, r.name) for r in documents.curated_names(names).collect()) == [(1, "idle-frame-0"), (1, "run-x"), (2, "frame-0")]
    documents.write_reports(spark.createDataFrame([(1, "pass")], "id int, status string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"id":1,"status":"pass"}'


def plain(v):
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = got.toPandas()
    if name in catalog.ORACLES:
        want = sql.execute(catalog.ORACLES[name]).df()
        columns = sorted(rows.columns)
        assert columns == sorted(want.columns)
        # integers with nulls are floats in one of the two frames
        flat = lambda d: sorted(tuple(plain(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else plain(None if v is not None and type(v).__name__ in ("NAType", "NaTType") else v) for v in r) for r in d[columns].astype(object).itertuples(index=False))
        assert flat(rows) == flat(want)
