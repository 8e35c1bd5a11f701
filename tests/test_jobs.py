"""Set-at-a-time operators against brute force, input order, hot keys and restarts."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plotline import schema
from plotline.functions import dates as D, text as T
from plotline.operators import cells as CE, community as C, filters as P, ingest as I, names as N, search as S, textjoin as X
from plotline.operators.gazetteer import read_gazetteer
from plotline.operators.stats import ranked_per, top_per, upper_median, upper_medians, with_count
from plotline.plans import fixture
from plotline.session import scratch_folder
from plotline.streaming import ingest as ST
from plotline.sources import readers as IN, snapshots as SN, writers as OUT

SF = "/root/testdata/sf0.001"


def arrivals(spark):
    accepted, _ = I.split_rejects(fixture.frame(spark, SF, "arrivals"))
    return I.with_dedup_key(accepted).drop("expected_key")


def a_year(spark):
    """The arrivals of few months, for tests that write the stored table several times."""
    return arrivals(spark).where(D.compact("transaction_date").rlike("^10[45]0[1-4]"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- statistics -----------------------------------------------------------
def test_upper_median_with_one_large_group(spark):
    rnd = random.Random(7)
    data = [("hot", rnd.choice([rnd.randint(0, 10**6), 500])) for _ in range(9000)]
    data += [(f"k{rnd.randint(0, 50)}", rnd.randint(0, 30)) for _ in range(4000)] + [(None, 3), (None, 9), ("x", None)]
    got = {r.k: r.m for r in upper_median(spark.createDataFrame(data, "k string, v long"), ["k"], "v", "m").collect()}
    want = {}
    for k in {k for k, v in data if v is not None}:
        vs = sorted(v for kk, v in data if kk == k and v is not None)
        want[k] = vs[len(vs) // 2]
    assert got == want


def test_counts_beside_rows_keep_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,)], "k string")
    assert sorted((str(r.k), r.n) for r in with_count(df, ["k"], "n").collect()) == [("None", 3)] * 3 + [("a", 2)] * 2


# --- import ---------------------------------------------------------------
def test_merge_does_not_depend_on_order_or_partitions(spark):
    a = arrivals(spark)
    once = rows(I.merge_duplicates(a).select("dedup_key", "serial_no", "lat", "building_type", "rooms"))
    shuffled = a.repartition(7, F.xxhash64("serial_no")).orderBy(F.xxhash64("address"))
    again = rows(I.merge_duplicates(shuffled).select("dedup_key", "serial_no", "lat", "building_type", "rooms"))
    assert once == again and len(once) > 1000


def test_import_twice_is_import_once(spark):
    path = scratch_folder(spark, "twice")
    a = a_year(spark)
    OUT.upsert_transactions(spark, a, path)
    first = rows(OUT.read_transactions(spark, path).select("dedup_key", "serial_no", "lat", "note"))
    OUT.upsert_transactions(spark, a, path)
    assert rows(OUT.read_transactions(spark, path).select("dedup_key", "serial_no", "lat", "note")) == first


def test_rows_without_key_survive_a_second_import(spark):
    path = scratch_folder(spark, "keyless")
    a = arrivals(spark).limit(40).withColumn(
        "dedup_key", F.when(F.pmod(F.xxhash64("serial_no"), F.lit(2)) == 0, F.col("dedup_key"))
    )
    a = a.unionByName(a.where("dedup_key is null"))
    OUT.upsert_transactions(spark, a, path)
    first = rows(OUT.read_transactions(spark, path).select("dedup_key", "serial_no"))
    assert len([r for r in first if r[0] is None]) == a.where("dedup_key is null").count() > 0
    OUT.upsert_transactions(spark, a, path)
    assert rows(OUT.read_transactions(spark, path).select("dedup_key", "serial_no")) == first


def test_first_row_of_a_file_wins_whatever_the_blocks(spark, tmp_path):
    lines = [",".join(schema.REGISTRY_COLUMNS), ",".join(schema.REGISTRY_COLUMNS)]
    at = {c: i for i, c in enumerate(schema.REGISTRY_COLUMNS)}
    for i in range(1200):
        row = [""] * len(at)
        row[at["address"]] = f"臺北市大安區仁愛路{i % 400 + 1}號"
        row[at["raw_district"]], row[at["transaction_date"]], row[at["total_price"]] = "大安區", "1130101", "5000000"
        row[at["serial_no"]] = f"S{i:05d}"
        lines.append(",".join(row))
    (tmp_path / "a.csv").write_text("\ufeff" + "\n".join(lines) + "\n", encoding="utf-8")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "20k", default):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = IN.read_registry_csv(spark, str(tmp_path / "a.csv")).withColumn("source_rank", F.lit(1))
            got = I.merge_duplicates(read).select("serial_no").collect()
            assert sorted(r[0] for r in got) == [f"S{i:05d}" for i in range(400)], size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)


def test_files_of_one_folder_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeff地址,總價\n臺北市大安區仁愛路1號,100\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("總價,備註,地址\n200,x,臺北市大安區仁愛路2號\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    got = IN.read_generic_csv(spark, str(tmp_path)).select("number", "total_price").collect()
    assert sorted(map(tuple, got)) == [("1", 100), ("2", 200)]


def test_gazetteer_keeps_the_order_of_its_file(spark, tmp_path):
    (tmp_path / "g.csv").write_text("district,city\n東區,新竹市\n東區,台中市\n東區,新竹市\n", encoding="utf-8")
    assert read_gazetteer(spark, str(tmp_path / "g.csv")).first().cities == ["新竹市", "台中市"]


def _files(spark, path, where):
    return set(rows(OUT.read_transactions(spark, path).where(where).select(F.input_file_name()).distinct()))


def test_upsert_reads_and_writes_the_groups_of_the_batch_only(spark):
    path = scratch_folder(spark, "groups")
    a = a_year(spark)
    OUT.upsert_transactions(spark, a, path, buckets=4)
    month, bucket = OUT.read_transactions(spark, path).where("tx_bucket = 2").select(OUT.MONTH, OUT.BUCKET).first()
    batch = OUT._grouped(a, 4).where((F.col(OUT.MONTH) == month) & (F.col(OUT.BUCKET) == bucket)).drop(OUT.MONTH, OUT.BUCKET)
    mine = (F.col(OUT.MONTH) == month) & (F.col(OUT.BUCKET) == bucket)
    others, own = _files(spark, path, ~mine), _files(spark, path, mine)
    OUT.upsert_transactions(spark, batch, path)
    assert _files(spark, path, ~mine) == others != set()
    assert _files(spark, path, mine).isdisjoint(own)
    assert SN.versions(spark, path) == [1, 2]


def test_a_stopped_write_leaves_the_old_table_whole(spark, monkeypatch):
    path = scratch_folder(spark, "stopped")
    a = a_year(spark)
    half = F.pmod(F.xxhash64("serial_no"), F.lit(2)) == 0
    OUT.upsert_transactions(spark, a.where(half), path)
    seen = lambda version=None: rows(OUT.read_transactions(spark, path, version).select("dedup_key", "serial_no", "note"))
    first, opened = seen(), OUT.read_transactions(spark, path).select("dedup_key", "serial_no", "note")

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(OUT, "publish", stop)
        with pytest.raises(RuntimeError, match="lost"):
            OUT.upsert_transactions(spark, a, path)
    assert seen() == first and SN.versions(spark, path) == [1]
    OUT.upsert_transactions(spark, a, path)
    before = I.merge_duplicates(a.where(half)).withColumns({"source_rank": F.lit(0), "ingest_seq": F.lit("")})
    once = rows(I.merge_duplicates(before.unionByName(a)).select("dedup_key", "serial_no", "note"))
    assert seen() == once != first
    assert seen(1) == first == rows(opened)  # an open reader keeps its version
    assert SN.vacuum(spark, path) > 0
    assert seen() == once and SN.versions(spark, path) == [2]
    assert SN.vacuum(spark, path) == 0


def test_a_version_is_published_once(spark):
    path = scratch_folder(spark, "once")
    a = arrivals(spark).limit(50)
    OUT.upsert_transactions(spark, a, path)
    with pytest.raises(RuntimeError, match="another writer"):
        SN.publish(spark, path, SN.snapshot(spark, path))
    assert SN.versions(spark, path) == [1]


def test_months_are_calendar_months(spark):
    dates = ["1130101", "990230", "0990101", "113/1/2", "11301", "9999999", "1131301", "", None, "20240101"]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dates], "transaction_date string").select(OUT._month()).collect()]
    assert got[:3] == ["m11301", "m9902", "m09901"] and got[5:9] == ["none"] * 4


def test_ranks_of_a_hot_key(spark):
    data = [("hot", i * 7919 % 5000, i) for i in range(5000)] + [(None, 1, 1), (None, 0, 2), ("a", None, 3)]
    df = spark.createDataFrame(data, "k string, v long, id long")
    got = ranked_per(df, ["k"], [F.col("v").desc_nulls_last(), F.col("id")], "r").collect()
    assert sorted((r.r, r.v) for r in got if r.k == "hot") == [(i + 1, 4999 - i) for i in range(5000)]
    assert sorted((r.r, r.v) for r in got if r.k is None) == [(1, 1), (2, 0)] and [r.r for r in got if r.k == "a"] == [1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 25, 997, 1001])
def test_medians_of_small_and_odd_groups(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([rnd.uniform(-1e9, 1e9), float(rnd.randint(0, 5)), 1e-300, 1e300]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = upper_medians(df, [], {"m": F.col("v")}).collect()
    assert [r.m for r in got if r.m is not None] == ([sorted(values)[n // 2]] if n else [])
    plan = upper_median(df, [], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


# --- boxes ----------------------------------------------------------------
BOXES = [(22.5, 23.5, 120.4, 121.2), (23.0, 23.0, 121.0, 121.0), (-90.0, 90.0, -180.0, 180.0), (24.99, 25.01, 121.49, 121.51), (-1.0, 1.0, -1.0, 1.0), (24.0, 23.0, 120.0, 121.0), (10.0, 11.0, 179.9, 400.0)]


@pytest.mark.parametrize("box", BOXES)
def test_ranges_cover_their_box(spark, box):
    rnd = random.Random(4)
    south, north, west, east = box
    ranges = CE.box_ranges(box)
    assert len(ranges) <= CE.RANGES and all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
    points = [(rnd.uniform(south, north), rnd.uniform(west, min(east, 180.0))) for _ in range(300)] + [(south, west), (north, min(east, 180.0))]
    df = spark.createDataFrame(points, "lat double, lng double")
    cells = [r[0] for r in df.select(CE.cell_of(F.col("lat"), F.col("lng"))).collect()]
    if south <= north:
        assert all(any(a <= c <= b for a, b in ranges) for c in cells)
    else:
        assert ranges == []


def test_cells_interleave_the_grid(spark):
    points = [(-90.0, -180.0), (90.0, 180.0), (25.03, 121.5), (-0.0001, 0.0), (0.0, -0.0001), (None, 1.0)]

    def cell(lat, lng):
        x, y = (min(int((v - low) / w * 2**20), 2**20 - 1) for v, low, w in ((lng, -180, 360), (lat, -90, 180)))
        return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(20))

    got = spark.createDataFrame(points, "lat double, lng double").select(CE.cell_of(F.col("lat"), F.col("lng")).alias("c"), CE.tile_of(F.col("c")).alias("t")).collect()
    assert [r.c for r in got] == [None if a is None else cell(a, b) for a, b in points]
    assert [r.t for r in got] == [-1 if r.c is None else r.c >> 20 for r in got]


def test_boxes_read_their_share_of_the_files(spark):
    path = scratch_folder(spark, "by_place")
    points = spark.range(40_000).select("id", (F.lit(21.0) + F.pmod(F.xxhash64("id"), F.lit(5000)) / 1000).alias("lat"), (F.lit(119.0) + F.pmod(F.hash("id"), F.lit(4000)) / 1000).alias("lng"))
    CE.write_by_place(points.unionByName(points.limit(5).select("id", F.lit(None).cast("double").alias("lat"), "lng")), path)
    table = spark.read.parquet(path)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    total = files(table)
    for box in [(23.0, 23.2, 120.0, 120.3), (22.0, 24.0, 119.5, 121.0), (0.0, 1.0, 0.0, 1.0)]:
        got = CE.in_box(table, box)
        plan = got._jdf.queryExecution().executedPlan().toString()
        chosen, pushed = (plan.split(f"{part}: [")[1].split("]")[0] for part in ("PartitionFilters", "PushedFilters"))
        assert "tile#" in chosen and "Or(" in pushed
        assert rows(got.select("id")) == rows(points.where(P.in_box(*box)).select("id"))
        area = max(0, box[1] - box[0]) * max(0, box[3] - box[2]) / 20
        assert files(got) <= total * area * 1.2 + 20  # tiles on the edge
    assert files(CE.in_box(table, (23.0, 23.2, 120.0, 120.3))) < total / 20


def test_merge_of_one_hot_key(spark):
    hot = spark.range(6000).select(
        F.lit(1).alias("source_rank"), F.lpad(F.col("id").cast("string"), 8, "0").alias("ingest_seq"),
        F.when(F.col("id") % 3 == 0, "1|a|1").otherwise(F.concat(F.lit("k"), "id")).alias("dedup_key"),
        F.when(F.col("id") == 4500, "名").alias("community_name"), F.lit("x號").alias("address"),
    )
    out = I.merge_duplicates(hot)
    assert out.count() == 4001
    assert out.where("dedup_key = '1|a|1'").first().community_name == "名"


def test_rows_without_key_are_kept(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (1, "b", None, "x"), (1, "c", "k", "y"), (2, "d", "k", "z")], "source_rank int, ingest_seq string, dedup_key string, note string")
    assert I.merge_duplicates(df).count() == 3


def test_registry_file_with_bom_and_short_rows(spark, tmp_path):
    from plotline import schema

    path = tmp_path / "a.csv"
    head = ",".join(f"欄{i}" for i in range(33))
    english = ",".join(f"The {n}" for n in schema.REGISTRY_COLUMNS)
    full = ["松山區", "房地", "臺北市松山區三民路２９巷１號三樓之３", "12.5"] + [""] * 3 + ["1130101", "", "三層", "十二層"] + [""] * 22
    full[21] = "1,000,000".replace(",", "")
    short = ["松山區", "房地", "臺北市松山區三民路５號", "", "", "", "", "990101"]
    text = "﻿" + "\n".join([head, english, ",".join(full), ",".join(short)]) + "\n"
    path.write_text(text, encoding="utf-8")
    got = {r.transaction_date: r for r in IN.read_registry_csv(spark, str(path)).collect()}
    a, b = got["1130101"], got["990101"]
    assert (a.street, a.lane, a.number, a.floor, a.sub_number, a.total_price, a.land_area) == ("三民路", "29", "1", "3", "3", 1000000, 12.5)
    assert (a.floor_level, a.total_floors, a.dedup_key) == ("3", "12", "1130101|松山區三民路29巷1號3樓之3|1000000")
    assert (b.number, b.note, b.total_price, b.dedup_key) == ("5", "", None, "990101|松山區三民路5號|0")


def test_json_cache_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"臺北市三民路1號": [25.05, 121.5], "far": [1.0, 2.0]}', encoding="utf-8")
    got = IN.read_json_cache(spark, str(tmp_path / "c.json")).collect()
    assert [(r.address_key, r.lat, r.lng) for r in got] == [("臺北市三民路1號", 25.05, 121.5)]


# --- text joins -----------------------------------------------------------
def _texts(rnd, n):
    return [(i, "".join(rnd.choice("大安區三民路一二段12號😀") for _ in range(rnd.randint(0, 14)))) for i in range(n)]


@pytest.mark.parametrize("n", [2, 3])
def test_phrase_index_is_exact(spark, n):
    rnd = random.Random(n)
    texts = _texts(rnd, 300)
    phrases = [(i, t[1][:k]) for i, (t, k) in enumerate((rnd.choice(texts), rnd.randint(1, 6)) for _ in range(80)) if t[1]]
    phrases = [(i, p) for i, p in phrases if p] + [(999, "沒有這個")]
    td, pd = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "pid long, phrase string")
    want = {(p, i) for p, ph in phrases for i, t in texts if ph in t}
    got = X.match_index(X.build_index(td, "id", "text", n), pd, "pid", "phrase", n)
    assert {(r.phrase_id, r.id) for r in got.collect()} == want
    if n == 2:
        assert {(r.phrase_id, r.id) for r in X.contains_join(td, pd, "id", "text", "pid", "phrase").collect()} == want


@pytest.mark.parametrize("longest", [1, 4, 16])
def test_phrases_in_long_texts_are_whole_and_leave_no_index(spark, monkeypatch, longest):
    rnd = random.Random(longest)
    texts = [(i, "".join(rnd.choice("大安區三路12號😀\n") for _ in range(rnd.randint(0, 120)))) for i in range(200)] + [(900, None)]
    cut = lambda t: (a := rnd.randint(0, len(t) - 1), t[a : a + rnd.randint(1, 60)])[1]
    phrases = [(i, cut(t)) for i, (_, t) in enumerate(rnd.choice(texts[:-1]) for _ in range(80)) if t] + [(997, ""), (998, None), (999, "大" * 40)]
    td, pd = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "pid long, phrase string")
    held, stage = [], X.stage
    monkeypatch.setattr(X, "stage", lambda df, name: (out := stage(df, name), held.append(out.count()))[0])
    got = X.find_in_texts(td, pd, "id", "text", "pid", "phrase", longest)
    assert sorted((r.phrase_id, r.id) for r in got.collect()) == sorted((p, i) for p, ph in phrases for i, t in texts if ph and t and ph in t)
    # What is kept follows the phrases, and the texts they may be in, not the characters of the texts.
    if longest == 16:
        assert sum(held) < sum(len(t) for _, t in texts if t)


def _levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_name_candidates_miss_nothing(spark):
    rnd = random.Random(3)
    alphabet = "甲乙丙丁戊己庚辛園社"
    word = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 7)))
    names = sorted({word() for _ in range(250)})
    keys = [(i, word()) for i in range(60)]
    nd = spark.createDataFrame([(n, n, 5, 0.0, 0.0, "") for n in names], "norm string, name string, tx_count long, avg_price double, avg_unit_price double, district string")
    qd = spark.createDataFrame(keys, "query_id long, keyword string")

    def tier(kw, name):
        it = iter(name)
        if kw == name:
            return "精確"
        if kw in name or name in kw:
            return "包含"
        if len(kw) >= 2 and all(c in it for c in kw):
            return "子序列"
        if _levenshtein(kw, name) <= max(1, len(kw) // 3):
            return "模糊"
        if len(kw) >= 2 and len(set(kw) & set(name)) / max(len(set(kw)), len(set(name))) >= 0.6:
            return "相似"
        return None

    want = {(q, n, t) for q, k in keys for n in names if (t := tier(k, n))}
    got = {(r.query_id, r.name, r.match_type) for r in N.match_names(nd, qd, 10**6).collect()}
    assert got == want

    def overlap(kw, name):
        if kw == name:
            return 100
        if kw in name:
            return int(70 + len(kw) / len(name) * 15)
        if name in kw:
            return int(60 + len(name) / len(kw) * 10)
        c, d = Counter(kw), Counter(name)
        ratio = sum(min(c[x], d[x]) for x in c) / len(kw)
        return int(ratio * 55) if ratio >= 0.55 else 0

    want = {(q, n, s) for q, k in keys for n in names if (s := overlap(k, n))}
    got = {(r.query_id, r.norm, r.score) for r in N.match_names_by_overlap(nd, qd, 10**6).collect()}
    assert got == want


def test_best_item_by_name(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(2, 6))).strip() or "a"
    items, keys = [(i, word()) for i in range(120)], [(i, word()) for i in range(40)]

    def score(kw, name):
        if kw == name:
            return 100
        if kw in name:
            return 80 + 2 * len(kw)
        if name in kw:
            return 70
        return int(sum(c in name for c in kw) / len(kw) * 40)

    want = {}
    for q, k in keys:
        s, i = max(((score(k, n), -i) for i, n in items))
        if s >= 20:
            want[q] = (-i, s)
    got = N.best_by_name(spark.createDataFrame(items, "item_id long, name string"), spark.createDataFrame(keys, "query_id long, keyword string"))
    assert {r.query_id: (r.item_id, r.score) for r in got.collect()} == want


# --- searches -------------------------------------------------------------
def test_search_methods_take_turns(spark):
    tx = fixture.frame(spark, SF, "tx_addr")
    one = tx.where("lane <> '' and alley = ''").first()
    part = lambda r: f"{r.street}{r.lane}巷{r.number}號"
    q = spark.createDataFrame(
        [(1, one.district + part(one)), (2, f"{one.number}號{one.floor}樓"), (3, one.address[3:12]), (4, "沒有"), (5, "")],
        "query_id long, query_text string",
    )
    out = S.search_addresses(tx, q, limit=None).select("query_id", "method", "id", "address").collect()
    methods = {r.query_id: r.method for r in out}
    assert methods[1] == "structured" and methods[2] == "phrase" and set(methods) <= {1, 2, 3}
    half = {r.id: r.address_half for r in tx.collect()}
    assert {r.id for r in out if r.query_id == 2} == {i for i, a in half.items() if f"{one.number}號{one.floor}樓" in a}


def test_shortened_texts_meet_rows_once(spark, monkeypatch):
    """Queries that share a street do not each get the street's rows while a longer text has some."""
    held, stage = {}, S.stage
    monkeypatch.setattr(S, "stage", lambda df, name: (out := stage(df, name), held.update({name: out.count()}))[0])
    tx = spark.createDataFrame([(i, f"三民路{i % 40 + 1}巷{i}號") for i in range(200)], "id long, address string")
    q = spark.createDataFrame([(i, f"三民路{i % 40 + 1}巷999號") for i in range(400)], "query_id long, query_text string")
    got = {(r.query_id, r.id) for r in S.search_shortened(tx, q, limit=None).collect()}
    assert got == {(a, b) for a in range(400) for b in range(200) if a % 40 == b % 40}
    assert held["shortened_hits"] <= 41 * 200


def test_keyword_search_keeps_first_path_and_district(spark):
    tx = fixture.frame(spark, SF, "tx_addr")
    one = tx.where("community_name <> ''").first()
    q = spark.createDataFrame([(1, f"{one.district}{one.street}", one.community_name)], "query_id long, query_text string, community string")
    got = S.keyword_search(tx, q, limit=2000).collect()
    every = tx.collect()
    named = {r.id for r in every if r.community_name == one.community_name and one.district in (r.district or "")}
    street = {r.id for r in every if r.street == one.street and r.district == one.district}
    assert {r.id for r in got} == named | street
    assert {r.id for r in got if r.path == 0} == named
    assert sorted(r.position for r in got) == list(range(1, len(got) + 1))


def test_links_fall_back_level_by_level(spark):
    rows_ = [
        (1, "松山區三民路29巷1號3樓", "松山區", "台北市", "甲園"), (2, "松山區三民路29巷1號5樓", "松山區", "台北市", "甲園"),
        (3, "松山區三民路29巷7之2號", "松山區", "台北市", "乙園"), (4, "松山區三民路100號", "松山區", "台北市", "丙園"),
        (5, "大安區三民路29巷1號", "大安區", "台北市", "丁園"),
    ]
    tx = spark.createDataFrame(rows_, "id long, address string, district string, county_city string, community_name string")
    q = spark.createDataFrame(
        [(1, "臺北市松山區三民路２９巷１號９樓"), (2, "松山區三民路29巷7號"), (3, "松山區三民路29巷99號"), (4, "松山區三民路500號"), (5, "三民路500號"), (6, "大安區仁愛路1號")],
        "query_id long, query_text string",
    )
    out = C.address_to_community(tx, q)
    best = {r.query_id: (r.community_name, r.confidence, r["count"]) for r in out.where("rank = 1").collect()}
    assert best == {1: ("甲園", 98, 2), 2: ("乙園", 98, 1), 3: ("甲園", 72, 2), 4: ("甲園", 40, 2)}


def test_address_ranges_text(spark):
    addr = [("甲", f"松山區三民路29巷{n}號") for n in (1, 3, 5)] + [("甲", f"松山區八德路四段{n}號") for n in range(1, 13)]
    addr += [("甲", "松山區南京東路口"), ("甲", "松山區健康路")]
    ranges = C.address_ranges(spark.createDataFrame(addr, "norm string, address string"))
    text = {r.road: r.formatted for r in ranges.collect()}
    assert text["三民路29巷"] == "三民路29巷1、3、5號"
    assert text["八德路四段"] == "八德路四段1～12號（共12個門牌）"
    assert text["健康路"] == "健康路（無門牌號碼）" and "南京東路" not in text
    line = C.range_summary(ranges).first()
    assert line.summary.startswith("八德路四段1～12號（共12個門牌）；三民路29巷1、3、5號")


def test_top_rows_are_whole_without_ties(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert top_per(df, ["k"], [F.col("id").desc()], 5).count() == 15


def test_names_with_spaces_and_widths(spark):
    df = spark.createDataFrame([(" Ａ加　ｂ館 ",)], "n string")
    r = df.select(T.community_name("n").alias("a"), T.community_name("n", "remove").alias("b")).first()
    assert (r.a, r.b) == ("A加 B館", "A加B館")


@pytest.mark.parametrize(("rule", "most"), [("tiers", 0.2), ("overlap", 0.08), ("item", 0.08)])
def test_name_searches_compare_few_pairs(spark, monkeypatch, rule, most):
    """Names of 18 letters of one alphabet; the share falls as the catalogue grows (README)."""
    from plotline.plans import linking as P

    titles, asks = P._titles(spark, "/root/testdata/sf0.01")
    seen, scored = [], N._scored

    def counted(names, queries, pairs):
        seen.append(pairs.count())
        return scored(names, queries, pairs)

    monkeypatch.setattr(N, "_scored", counted)
    names = titles.select(F.upper("name").alias("norm"), "name", "tx_count", F.lit("").alias("district"), *[F.lit(0.0).alias(c) for c in ("avg_price", "avg_unit_price")])
    if rule == "tiers":
        N.match_names(names, asks, 3)
    elif rule == "overlap":
        N.match_names_by_overlap(names, asks, 3)
    else:
        N.best_by_name(titles, asks)
    assert 0 < sum(seen) < most * titles.count() * asks.count()


def test_only_the_best_names_of_a_block_are_scored(spark, monkeypatch):
    """Letters of one alphabet, in which many names share most of a keyword's; blocks of several names and keywords."""
    from plotline.plans import linking as P

    titles, asks = P._titles(spark, "/root/testdata/sf0.001")
    seen, scored = [], N._scored
    monkeypatch.setattr(N, "_scored", lambda n, q, pairs: (seen.append(pairs.count()), scored(n, q, pairs))[1])
    whole = rows(N.best_by_name(titles, asks))
    monkeypatch.setattr(N, "_BLOCK", 50)
    assert rows(N.best_by_name(titles, asks)) == whole
    names = titles.select(F.upper("name").alias("norm"), "name", "tx_count", F.lit("").alias("district"))
    N.match_names_by_overlap(names, asks, 3)
    # The nearest names and the few looked at beyond them, and names that hold the keyword.
    assert 0 < max(seen) < 12 * asks.count()


def test_names_are_few_steps_from_all_names(spark):
    """Long and short keywords, letters that no name has, doubled letters; against the scores of all names."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("aabbcdefgh") for _ in range(n))
    names = sorted({word(rnd.randint(1, 24)) for _ in range(220)})
    keys = [(i, word(rnd.randint(1, 24)) + rnd.choice(["", "zz", "a"])) for i in range(50)] + [(99, "zzzz"), (98, "aaaa")]
    nd = spark.createDataFrame([(n.upper(), n, len(n) % 7, 0.0, 0.0, "") for n in names], "norm string, name string, tx_count long, avg_price double, avg_unit_price double, district string")
    qd = spark.createDataFrame(keys, "query_id long, keyword string")
    for run in (lambda n: N.match_names(nd, qd, n), lambda n: N.match_names_by_overlap(nd, qd, n)):
        every = defaultdict(list)
        for r in run(10**6).collect():
            every[r.query_id].append((-r.score, -r.tx_count, r.name))
        for n in (1, 4):
            got = defaultdict(list)
            for r in run(n).collect():
                got[r.query_id].append((-r.score, -r.tx_count, r.name))
            assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:n] for q, v in every.items()}


@pytest.mark.parametrize("rule", ["size", "repeats", "weighted"])
@pytest.mark.parametrize("alphabet", ["abcdefgh", "".join(chr(0x4E00 + 7 * k) for k in range(600))])
def test_blocks_of_letters_are_counted_whole(monkeypatch, rule, alphabet):
    """Turns, strips and counts of few pairs; own bits and shared ones; names of equal letters."""
    import numpy as np
    import pyarrow as pa

    from plotline.operators import letters as L

    for name, n in (("_FIRST", 4), ("_NAMES", 16), ("_PAIRS", 64), ("_PENDING", 50)):
        monkeypatch.setattr(L, name, n)
    rnd = random.Random(rule)
    some = rnd.sample(alphabet, min(200, len(alphabet)))
    word = lambda: "".join(sorted(rnd.choice(some) for _ in range(rnd.randint(1, 12))))
    near = lambda w: "".join(sorted(w[1:] + rnd.choice(some)))
    words = [word() for _ in range(150)]
    form = (lambda w: "".join(sorted(set(w)))) if rule != "repeats" else str
    held = defaultdict(list)
    for place, w in enumerate(words + [near(w) for w in words for _ in range(3)]):
        held[form(w)].append((place, max(0.0, 9.0 - place // 60)))
    asked = [near(rnd.choice(words)) for _ in range(60)] + ["~~", "".join(some)]
    asked = sorted({form(w) if rule == "size" else w for w in asked})
    of_size = rule == "size"
    points = lambda same, n, size, trades: np.where(same >= 0.4 * n, np.floor((same / (np.maximum(n, size) if of_size else n) * 50 + trades * of_size) * 10) / 10, 0.0)
    least = lambda level, n, size, trades: np.maximum(0.4 * n, (level - trades * of_size) / 50 * (np.maximum(n, size) if of_size else n)) - 1e-4

    def shared(a, b):
        return sum(c in b for c in a) if rule == "weighted" else sum((Counter(a) & Counter(b)).values())

    def table(**columns):
        return pa.table({c: pa.array(v, t) for c, (v, t) in columns.items()})

    names = table(
        letters=(list(held), pa.string()), size=([float(len(k)) for k in held], pa.float64()),
        places=([[p for p, _ in v] for v in held.values()], pa.list_(pa.int64())), trades=([[t for _, t in v] for v in held.values()], pa.list_(pa.float64())),
    )
    ids = list(range(len(asked)))
    every = {
        i: sorted((-float(points(shared(a, k), len(a), len(k), t)), p) for k, v in held.items() for p, t in v)
        for i, a in enumerate(asked)
    }
    every = {i: [x for x in v if x[0] < 0] for i, v in every.items()}
    for bars in (None, [-every[i][5][0] if len(every[i]) > 5 else 0.0 for i in ids]):
        last = [every[i][5][1] if len(every[i]) > 5 else 0 for i in ids]
        asks = table(
            query_id=(ids, pa.int64()), letters=(asked, pa.string()), n=([float(len(a)) for a in asked], pa.float64()),
            bar=(bars or [float("nan")] * len(ids), pa.float64()), last=(last, pa.int64()),
        )
        got = defaultdict(list)
        for r in L.best_pairs(L.Rule(points, least, 0.1, rule == "weighted"), 6)(names, asks).to_pylist():
            got[r["query_id"]].append((-r["points"], r["place"]))
        assert sum(map(len, every.values())) > 300
        assert {i: sorted(v) for i, v in got.items()} == {i: v[:6] if bars is None or len(v) > 5 else v for i, v in every.items() if v}


def test_names_that_spell_a_keyword_are_cut_to_the_best():
    import pyarrow as pa

    from plotline.operators import letters as L

    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("aabcd😀中") for _ in range(rnd.randint(1, n)))
    texts = [word(14) for _ in range(400)] + ["ab" * 60, "b" * 80 + "a" + "c" * 80]
    gain = [float(max(0, 50 - k // 3)) for k in range(len(texts))]
    kws = [word(5) for _ in range(80)] + ["z"]
    names = pa.table({"norm": texts, "place": pa.array(range(len(texts)), pa.int64()), "gain": gain})
    asks = pa.table({"query_id": pa.array(range(len(kws)), pa.int64()), "kw": kws})

    def spells(kw, text):
        rest = iter(text)
        return all(c in rest for c in kw)

    for top_n in (3, 10**6):
        got = defaultdict(set)
        for r in L.spelled(top_n)(names, asks).to_pylist():
            got[r["query_id"]].add(r["norm"])
        for i, kw in enumerate(kws):
            hits = sorted((-round(len(kw) / len(t) * 200 + 200 + gain[j], 1), j) for j, t in enumerate(texts) if spells(kw, t))
            assert {texts[j] for _, j in hits[:top_n]} <= got[i] <= {texts[j] for _, j in hits}
            assert top_n == 10**6 or len(got[i]) < 30


def test_names_and_keywords_that_hold_each_other_are_whole_and_dealt_over_tasks(spark):
    names = ["大安", "大安區大安路", "安", "xx大安xx", "大安區", ""] + [f"大安區大安{c}" for c in "甲乙丙丁戊"]
    kws = [(1, "大安"), (2, "大安區大安路九號"), (3, "安"), (3, "大安區"), (4, "大安區大安"), (5, "沒有這個名字")]
    nd, qd = spark.createDataFrame([(n,) for n in names], "norm string"), spark.createDataFrame(kws, "query_id long, kw string")
    held, inside = N._holding(nd, qd), N._inside(nd, qd)
    assert set(rows(held)) == {(q, n) for q, k in kws for n in names if k in n}
    assert set(rows(inside)) == {(q, n) for q, k in kws for n in names if n and n in k}
    for out in (held, inside):
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_watermarks_bound_the_state(spark):
    """One day a file: rows of the days behind the watermark leave the state, and late copies are not let in again."""
    landing, out, mark = (scratch_folder(spark, n) for n in ("days", "out", "mark"))
    day = lambda k: F.timestamp_seconds(F.lit(86_400 * (k + 9000)))
    sizes = []
    for k in range(12):
        rows = spark.range(k * 50, k * 50 + 50).withColumn("at", day(k))
        rows = rows.unionByName(rows.limit(5)).unionByName(spark.range(20).withColumn("at", day(0)))
        rows.coalesce(1).write.mode("append").parquet(landing)
        if k in (5, 11):  # stopped and started once
            q = ST.append_stream(ST.unique_rows(ST.read_landing(spark, landing, rows.schema, 1), "id", "at", "2 days"), out, mark)
            q.awaitTermination()
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(600))
    assert max(sizes) <= 5 * 50 and len(sizes) >= 12


def test_duplicates_are_merged_in_one_pass(spark):
    given = spark.createDataFrame(
        [("k", 1, "a", "", "n1"), ("k", 1, "b", "x", "n2"), ("k", 2, "c", "y", ""), (None, 1, "d", "", ""), (None, 1, "d", "", "")],
        "dedup_key string, source_rank int, ingest_seq string, building_type string, note string",
    )
    merged, first = I.merge_duplicates(given), I.first_by_key(given)
    for out in (merged, first):
        assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    none = (None, 1, "d", "", "")
    by_key = lambda out: sorted(map(tuple, out.collect()), key=str)
    assert by_key(merged) == sorted([("k", 1, "a", "x", "n1"), none, none], key=str)
    assert by_key(first) == sorted([("k", 1, "a", "", "n1"), none, none], key=str)


# --- equal texts are handled once -----------------------------------------
def test_equal_texts_are_indexed_once(spark, tmp_path):
    texts = [(i, ["三民路12號", "三民路3號", ""][i % 3]) for i in range(60)] + [(99, None)]
    td = spark.createDataFrame(texts, "id long, text string")
    pd = spark.createDataFrame([(1, "路12"), (2, "路"), (2, "3號"), (3, "沒有")], "pid long, phrase string")
    path = str(tmp_path / "index")
    X.write_index(td, "id", "text", path, form=lambda c: F.translate(c, "三", "３"))
    assert spark.read.parquet(f"{path}/postings").count() == len("三民路12號") + len("三民路3號")
    want = {(p, i) for p, ph in [(1, "路12"), (2, "路")] for i, t in texts if t and ph in t}
    assert rows(X.search_index(spark, path, pd, "pid")) == sorted(want, key=repr)
    assert rows(X.search_index_any(spark, path, pd, "pid")) == sorted({(i,) for _, i in want}, key=repr)
    counts = {r.gram: (r.places, r.texts) for r in X.piece_counts(spark.createDataFrame([(1, "abab"), (2, "abab"), (3, "ab")], "id long, text string"), "id", "text").collect()}
    assert counts == {"ab": (5, 3), "ba": (2, 2), "b": (3, 3)}


def test_equal_rows_are_parsed_and_matched_once(spark, monkeypatch):
    from plotline.plans import registry, searches as plans

    tx = fixture.frame(spark, SF, "tx_addr").where("id < 60")
    copies = tx.withColumn("id", F.explode(F.sequence(F.col("id"), F.col("id") + 10000 * 4, F.lit(10000))))
    kinds = ", ".join(f"{n} {t}" for n, t in copies.dtypes)
    copies = spark.createDataFrame([tuple(r) for r in copies.collect()] + [(None,) * len(copies.columns)], kinds)
    seen, parsed = [], S.parse_queries
    monkeypatch.setattr(plans, "frame", lambda *a: copies)
    monkeypatch.setattr(S, "parse_queries", lambda q, *a: seen.append(q.count()) or parsed(q, *a))
    got = rows(registry.QUERIES["r1_floor_and_sub_number"](spark, SF))
    queries = parsed(copies.select(F.col("id").alias("query_id"), F.col("address").alias("query_text")))
    assert got == rows(S.search_level(copies, queries, 1)) and len(got) >= 25 * tx.count()
    assert seen == [copies.select(*S.HOUSE).distinct().count()]


def test_numbers_tell_values_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", None), (2, None, "a"), (3, "a", None), (4, "", "a"), (5, None, None)], "id long, x string, y string")
    every, numbers = S.numbered(df, "id", ["x", "y"])
    of = {r.id: r.number_of for r in numbers.collect()}
    assert of[1] == of[3] and len(set(of.values())) == 4 == every.count()
    assert {(r.x, r.y): r.number_of for r in every.collect()} == {("a", None): of[1], (None, "a"): of[2], ("", "a"): of[4], (None, None): of[5]}
    # A seed that gives differing values one number is not used.
    hashed, tried = F.xxhash64, []
    monkeypatch.setattr(F, "xxhash64", lambda *c: tried.append(c) or (F.lit(7).cast("long") if len(tried) == 1 else hashed(*c)))
    again = {r.id: r.number_of for r in S.numbered(df, "id", ["x", "y"])[1].collect()}
    assert len(tried) == 2 and again[1] == again[3] and len(set(again.values())) == 4


def test_equal_addresses_are_searched_once(spark, monkeypatch):
    tx = fixture.frame(spark, SF, "tx_addr")
    copies = tx.where("id < 40").withColumn("id", F.explode(F.sequence(F.col("id"), F.col("id") + 10000 * 7, F.lit(10000))))
    copies = spark.createDataFrame(copies.collect(), copies.schema)
    data = copies.select("id", "address", "address_half").collect()
    seen = {"texts": [], "rows": []}
    joined, matched = X.contains_join, S.match_keys
    monkeypatch.setattr(X, "contains_join", lambda t, *a: seen["texts"].append(t.count()) or joined(t, *a))
    monkeypatch.setattr(S, "match_keys", lambda t, *a: seen["rows"].append(t.count()) or matched(t, *a))
    first = data[0].address_half
    asked = [(1, first.split("號")[0] + "號"), (2, "1號"), (3, "1號"), (4, "沒有這個")]
    q = spark.createDataFrame(asked, "query_id long, query_text string")
    parsed = S.parse_queries(q)
    per = Counter(r.address for r in data)
    for limit in (None, 20):
        got = S.search_phrase(copies, parsed, limit=limit).select("query_id", "id", "addr_count", "address").collect()
        want = {k: {r.id for r in data if t in r.address_half} for k, t in asked}
        for k, ids in want.items():
            mine = [r.id for r in got if r.query_id == k]
            assert len(mine) == (len(ids) if limit is None else min(limit, len(ids))) and set(mine) <= ids
        assert got and all(r.addr_count == per[r.address] for r in got)
    named = S.search_structured(copies, parsed, limit=None).collect()
    assert named and all(r.query_id == 1 and r.addr_count == per[r.address] for r in named)
    assert {r.id for r in data if r.address_half.startswith(asked[0][1])} == {r.id for r in named}
    assert set(seen["texts"]) == {len(per)} and seen["rows"] == [len(per)] and len(data) == 8 * len(per)
