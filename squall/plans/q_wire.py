"""Registered queries on files, messages, names, timing, sites and real-time chunks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from squall.functions import display, geo, names, timing, wire
from squall.operators import chunks as CH
from squall.operators import digests, summaries
from squall.plans import adapters as A
from squall.plans.adapters import ARCHIVES, CHUNKS, CUTS, MESSAGES, RAW, WORDS, R
from squall.sources import archive, columnar, listing, stations
from squall.sources import layouts as L

QUERIES: dict = {}
ORACLES: dict = {}
SITES = stations.sites_sql()


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- synthetic volumes: files of five tilts and at most 250 vectors, written and read back ----

#: Vectors whose radials make two volumes, at most.
BLOCK = 250
VOLUME = f"'v' || (label % 2) || '-' || (vec_id // {BLOCK})"
VOLUME_R = VOLUME.replace("label", "sweep_idx")
FILE = f"concat('v', sweep_idx % 2, '-', floor(vec_id / {BLOCK}))"
#: Azimuth numbers that a halfword tells apart.
NUMBERS = 65536
EVERY_VOLUME = f"(select distinct {VOLUME} volume_id from embeddings)"


def volumes(s, d):
    """volume_id v0-0, v1-0, v0-1, ...: a metadata record, then a record per tilt."""
    r = A.radials(s, d).withColumn("file", F.expr(FILE))

    def build(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda x: (x["sweep_idx"], x["az_idx"]))
        cut = L.write(L.PATTERN_CUT, {"elevation_angle": 1820, "waveform_type": 1, "super_resolution": 1, "azimuth_rate": 4000})
        pattern = L.write(L.PATTERN_HEADER, {"pattern_type": 2, "pattern_number": 212, "n_cuts": 3, "pulse_width": 2, "doppler_resolution": 2}) + cut * 3
        status = L.write(L.STATUS, {"rda_status": 16, "vcp": -212, "build_number": 1900, "scan_data_flags": 5, "alarm_3": 17})
        records = [archive.message_bytes(2, status, 18000, 1) + archive.message_bytes(5, pattern, 18000, 2)]
        for tilt in sorted({x["sweep_idx"] for x in rows}):
            part = b""
            for x in (x for x in rows if x["sweep_idx"] == tilt):
                head = {"radar_identifier": "KTLX", "mjd": 18000, "ms": x["vec_id"] * 13, "azimuth_number": (x["az_idx"] + 1) % NUMBERS, "azimuth_angle": x["azimuth_deg"], "azimuth_resolution_spacing": 2, "elevation_number": tilt + 1, "elevation_angle": x["elevation_deg"], "radial_status": 1}
                raw = [int(abs(float(v)) * 400.0) for v in x["embedding"]]
                moment = {"scale": 2.0, "offset": 66.0, "first_gate_m": 2000, "gate_interval_m": 250, "raw": raw}
                wide = {"scale": 100.0, "offset": 2.0, "first_gate_m": 2000, "gate_interval_m": 250, "raw": [v * 100 for v in raw], "word_size": 16}
                body = archive.radial_bytes(head, {"REF": moment, "PHI": wide} if x["vec_id"] % 2 else {"REF": moment}, {"latitude": 35.3331, "longitude": -97.2778, "site_height": 370, "tower_height": 10, "vcp": 212})
                part += archive.message_bytes(31, body, 18000, x["vec_id"] * 13)
            records.append(part)
        return pa.table({"volume_id": [rows[0]["file"]], "content": pa.array([archive.volume_bytes(records, {"mjd": 18000, "ms": 5000})], pa.binary())})

    # dealt over all cores: what a worker holds follows the number of volumes of its part, not how few parts small tables are put into
    return A.spread(r, "file").groupBy("file").applyInArrow(build, "volume_id string, content binary")


def _counted_on(s, d, r):
    """Radials with azimuth numbers counted on: a number of the wire is a halfword and begins anew after 65,535, so it is taken from the first one of the file's tilt."""
    first = A.radials(s, d).groupBy(F.expr(FILE).alias("f"), F.col("elevation_number").alias("t")).agg((F.min("az_idx") + 1).alias("first"))
    r = r.join(first, (F.col("volume_id") == F.col("f")) & (F.col("elevation_number") == F.col("t")))
    return r.withColumn("azimuth_number", F.col("first") + F.pmod(F.col("azimuth_number") - F.col("first"), F.lit(NUMBERS)))


@add("a01_load_volume", f"""select volume_id, k::int sweep_idx, count(distinct vec_id) n_radials, sum(raw)::bigint sum_raw, count(*) n_gates from (select {VOLUME} volume_id,
 dense_rank() over (partition by {VOLUME} order by label) - 1 k, vec_id, unnest(list_transform(embedding, lambda x: floor(abs(x::double) * 400e0)::int)) raw from embeddings) group by all""")
def a01(s, d):
    r = archive.scan(volumes(s, d)).select("volume_id", "sweep_idx", "ordinal", F.explode("REF.raw").alias("raw"))
    return r.groupBy("volume_id", "sweep_idx").agg(F.countDistinct("ordinal").alias("n_radials"), F.sum("raw").alias("sum_raw"), F.count(F.lit(1)).alias("n_gates"))


@add("a16_volume_header", f"select volume_id, 'AR2V0006.' tape_filename, '001' extension, 18000::bigint mjd, 5000::bigint ms, 'KTLX' icao from {EVERY_VOLUME}")
def a16(s, d):
    return archive.volume_headers(volumes(s, d)).drop("time")


@add("b03_split_records", f"select {VOLUME} volume_id, count(distinct label) + 1 n_records, true all_compressed from embeddings group by 1")
def b03(s, d):
    return archive.split_volumes(volumes(s, d)).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_records"), F.min("compressed").alias("all_compressed"))


@add("b07_decode_messages", f"select {VOLUME} volume_id, 31 message_type, count(*) n from embeddings group by 1 union all select volume_id, k, 1 from {EVERY_VOLUME}, (values (2), (5)) t(k)")
def b07(s, d):
    return archive.decode_records(archive.split_volumes(volumes(s, d))).groupBy("volume_id", "message_type").agg(F.count(F.lit(1)).alias("n"))


@add("b11_record_radials", f"select {VOLUME_R} volume_id, elevation_number, count(*) n, min(az_idx) + 1 first_azimuth, max(az_idx) + 1 last_azimuth from {R} group by all")
def b11(s, d):
    r = _counted_on(s, d, archive.radials(archive.decode_records(archive.split_volumes(volumes(s, d)))))
    return r.groupBy("volume_id", "elevation_number").agg(F.count(F.lit(1)).alias("n"), F.min("azimuth_number").alias("first_azimuth"), F.max("azimuth_number").alias("last_azimuth"))


@add("c01_radial_moments", f"""select {VOLUME_R} volume_id, az_idx + 1 azimuth_number, elevation_number, vec_id % 2 = 1 has_phi, 64 n_gates, (18000 - 1) * 86400000::bigint + vec_id * 13 time_ms,
 list_sum(list_transform(embedding, lambda x: floor(abs(x::double) * 400e0)))::bigint * 100 * (vec_id % 2) sum_phi from {R}""")
def c01(s, d):
    r = _counted_on(s, d, archive.radials(archive.decode_records(archive.split_volumes(volumes(s, d)))))
    total = F.aggregate(F.coalesce("PHI.raw", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return r.select("volume_id", "azimuth_number", "elevation_number", F.col("PHI").isNotNull().alias("has_phi"), F.col("REF.gate_count").alias("n_gates"), "time_ms", total.alias("sum_phi"))


@add("c09_status_body", f"select volume_id, 16 rda_status, -212 vcp, 1900 build_number, 17 alarm, 'RDAStatusData' type_name from {EVERY_VOLUME}")
def c09(s, d):
    b = archive.bodies(archive.decode_records(archive.split_volumes(volumes(s, d)))).where("message_type = 2")
    j = F.from_json("body", "rda_status int, vcp int, build_number int, alarms array<int>")
    return b.select("volume_id", j.alias("j"), "type_name").select("volume_id", "j.rda_status", "j.vcp", "j.build_number", F.col("j.alarms")[2].alias("alarm"), "type_name")


@add("c15_pattern_body", f"select volume_id, 212 pattern_number, 3 n_cuts, k cut_no, 1820 elevation_angle, 1 half_degree from {EVERY_VOLUME}, (values (0), (1), (2)) c(k)")
def c15(s, d):
    b = archive.bodies(archive.decode_records(archive.split_volumes(volumes(s, d)))).where("message_type = 5")
    j = F.from_json("body", "pattern_number int, n_cuts int, cuts array<struct<elevation_angle:int,super_resolution:int>>")
    b = b.select("volume_id", j.alias("j")).select("volume_id", "j.pattern_number", "j.n_cuts", F.posexplode("j.cuts").alias("cut_no", "c"))
    return b.select("volume_id", "pattern_number", "n_cuts", "cut_no", "c.elevation_angle", F.col("c.super_resolution").bitwiseAND(F.lit(1)).alias("half_degree"))


@add("l03_trim_volume", f"select {VOLUME} volume_id, (label + 1) elevation_number, count(*) n from embeddings where label in (2, 5) group by all")
def l03(s, d):
    return archive.scan(volumes(s, d), sweeps={3, 6}).groupBy("volume_id", "elevation_number").agg(F.count(F.lit(1)).alias("n"))


@add("d13_retention", f"select {VOLUME} volume_id, count(distinct label) filter (label in (2, 4, 5)) + 1 n_records from embeddings group by all")
def d13(s, d):
    return archive.split_volumes(archive.trim(volumes(s, d), {3, 5, 6})).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_records"))


@add("f15_decode_summary", f"select {VOLUME} volume_id, label + 1 elevation_number, count(*) n_ref, count(*) filter (vec_id % 2 = 1) n_phi, 0::bigint n_vel from embeddings group by all")
def f15(s, d):
    r = archive.scan(volumes(s, d))
    return r.groupBy("volume_id", "elevation_number").agg(F.count("REF").alias("n_ref"), F.count("PHI").alias("n_phi"), F.count("VEL").alias("n_vel"))


@add("f16_record_summary", f"""select volume_id, dense_rank() over (partition by volume_id order by sweep_idx)::int record_idx, 'radials' as kind, n, first_elevation from
 (select {VOLUME_R} volume_id, sweep_idx, count(*) n, min(elevation_number) first_elevation from {R} group by all) union all select volume_id, 0, 'metadata', 2, null from {EVERY_VOLUME}""")
def f16(s, d):
    m = archive.decode_records(archive.split_volumes(volumes(s, d)))
    r = archive.radials(m).withColumn("record_idx", F.floor(F.col("ordinal") / 1_000_000).cast("int")).groupBy("volume_id", "record_idx").agg(F.min_by("elevation_number", "ordinal").alias("first_elevation"))
    g = m.groupBy("volume_id", "record_idx").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("message_type") == 31).cast("int")).alias("has"))
    return g.join(r, ["volume_id", "record_idx"], "left").select("volume_id", "record_idx", F.when(F.col("has") == 1, "radials").otherwise("metadata").alias("kind"), "n", "first_elevation")


@add("b01_gunzip", ORACLES["a01_load_volume"])
def b01(s, d):
    import gzip

    packed = archive._rows(volumes(s, d), lambda r: [{"volume_id": r["volume_id"], "content": gzip.compress(r["content"])}], "volume_id string, content binary")
    r = archive.scan(packed).select("volume_id", "sweep_idx", "ordinal", F.explode("REF.raw").alias("raw"))
    return r.groupBy("volume_id", "sweep_idx").agg(F.countDistinct("ordinal").alias("n_radials"), F.sum("raw").alias("sum_raw"), F.count(F.lit(1)).alias("n_gates"))


@add("b12_chunk_kind", f"select volume_id, record_idx, case when record_idx = 0 then 'Start' else 'IntermediateOrEnd' end as kind from (select {VOLUME} volume_id, (dense_rank() over (partition by {VOLUME} order by label))::int record_idx from embeddings union select volume_id, 0 from {EVERY_VOLUME})")
def b12(s, d):
    v = volumes(s, d)
    head = v.select("volume_id", F.lit(0).alias("record_idx"), F.col("content").alias("data"))
    both = head.unionByName(archive.split_volumes(v).where("record_idx > 0").select("volume_id", "record_idx", "data"))
    return archive._rows(both, lambda r: [{"volume_id": r["volume_id"], "record_idx": r["record_idx"], "kind": archive.chunk_kind(r["data"])}], "volume_id string, record_idx int, kind string")


@add("c03_volume_block", f"select volume_id, round(35.3331::float::double, 6) latitude, round((-97.2778)::float::double, 6) longitude, 380e0 antenna_m, 212 vcp from {EVERY_VOLUME}")
def c03(s, d):
    r = archive.scan(volumes(s, d)).select("volume_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), (F.col("site_height_m") + F.col("tower_height_m")).alias("antenna_m"), "vcp")
    return r.distinct()


def _messages(s, rows, encode):
    """A record of one message per row, cut into messages again; encode(row) gives (type, payload)."""

    def work(row):
        kind, payload = encode(row)
        data = archive.message_bytes(kind, payload, 18000, row["key"])
        yield {"volume_id": str(row["key"]), "record_idx": 0, "offset": 0, "size": len(data), "compressed": False, "data": data, "_corrupt": None}

    return archive.decode_records(archive._rows(rows, work, archive.RECORDS))


@add("c08_legacy_radials", f"select vec_id as key, az_idx + 1 azimuth_number, round((floor(azimuth_deg * 100e0)::int % 32768) * 180e0 / 32768e0, 6) azimuth_deg, elevation_number, 0.5e0 first_gate_km, list_sum(list_transform(embedding, lambda x: floor(abs(x::double) * 400e0)))::bigint sum_raw, 64 n_gates from {R}")
def c08(s, d):
    def encode(r):
        raw = bytes(int(abs(float(v)) * 400.0) for v in r["embedding"])
        head = {"mjd": 18000, "ms": r["key"], "azimuth_angle": int(r["azimuth_deg"] * 100.0) % 32768, "azimuth_number": r["az_idx"] + 1, "elevation_number": r["elevation_number"], "surveillance_first": -500, "surveillance_interval": 1000, "surveillance_gates": len(raw), "ref_pointer": L.size(L.LEGACY_RADIAL)}
        return 1, L.write(L.LEGACY_RADIAL, head) + raw

    r = archive.radials(_messages(s, A.radials(s, d).withColumnRenamed("vec_id", "key"), encode))
    total = F.aggregate("REF.raw", F.lit(0).cast("long"), lambda a, x: a + x)
    return r.select(F.col("volume_id").cast("long").alias("key"), "azimuth_number", F.round("azimuth_deg", 6).alias("azimuth_deg"), "elevation_number", F.col("REF.first_gate_km").alias("first_gate_km"), total.alias("sum_raw"), F.col("REF.gate_count").alias("n_gates"))


def _records(rows, encode):
    """A record of one message per row; encode(columns) gives (types, payloads) of all rows."""

    def work(columns):
        kinds, payloads, *sizes = encode(columns)
        return columnar.messages(kinds, payloads, 18000, columns["key"], sizes=sizes[0] if sizes else None)

    return archive.message_records(rows, work)


def _words(*columns):
    """Halfwords of a payload, a column each."""
    return np.stack([np.broadcast_to(x, len(columns[0])) for x in columns], 1).astype(">u2").view(np.uint8)


def _bodies(rows, kind: int, encode, schema: str):
    b = archive.record_bodies(_records(rows, lambda r: (kind, *encode(r))), schema, (kind,))
    return b.select(F.col("volume_id").cast("long").alias("key"), "body.*")


def _word_rows(s, d):
    return A.spread(A.words(s, d).withColumnRenamed("o_orderkey", "key"), "key")


@add("c14_console_text", "select p_partkey as key, length(p_name) as size, p_name as text from part")
def c14(s, d):
    rows = A.read(s, d, "part").select(F.col("p_partkey").alias("key"), "p_name")

    def encode(r):
        texts = [x.encode() for x in r["p_name"]]
        sizes = np.array([len(x) for x in texts])
        return np.concatenate([_words(sizes), np.array(texts, f"S{max(1, sizes.max())}")[:, None].view(np.uint8)], 1), sizes + 2

    return _bodies(A.spread(rows, "key"), 4, encode, "size long, text string")


@add("c19_control_commands", f"select o_orderkey as key, w::bigint state_command, c::bigint local_vcp, (v - 32768)::bigint zdr_bias_estimate from {WORDS}")
def c19(s, d):
    fields = lambda r: {"state_command": r["w"], "local_vcp": r["c"], "zdr_bias_estimate": r["v"] - 32768}
    return _bodies(_word_rows(s, d), 6, lambda r: (L.write_many(L.CONTROL_COMMANDS, len(r["w"]), fields(r)),), "state_command long, local_vcp long, zdr_bias_estimate long")


@add("c22_loopback", f"select o_orderkey as key, 3::bigint as size, lower(lpad(hex(w), 4, '0') || lpad(hex(v), 4, '0')) pattern from {WORDS}")
def c22(s, d):
    return _bodies(_word_rows(s, d), 11, lambda r: (_words(r["w"] * 0 + 3, r["w"], r["v"]),), "size long, pattern string")


@add("c26_prf_data", f"select o_orderkey as key, 2 n_waveforms, [w::bigint, v::bigint]::varchar prfs from {WORDS}")
def c26(s, d):
    b = _bodies(_word_rows(s, d), 32, lambda r: (_words(r["w"] * 0 + 2, 0, 1, 2, 0, r["w"], 0, r["v"], 2, 0),), "waveforms array<struct<waveform:int,prfs:array<long>>>")
    return b.select("key", F.size("waveforms").alias("n_waveforms"), F.concat(F.lit("["), F.array_join(F.col("waveforms")[0]["prfs"].cast("array<string>"), ", "), F.lit("]")).alias("prfs"))


@add("c27_log_data", f"select o_orderkey as key, c::bigint as version, 'LOG' || c identifier, lower(lpad(hex(v), 4, '0')) payload_hex from {WORDS}")
def c27(s, d):
    fields = lambda r: {"version": r["c"], "identifier": np.char.add(b"LOG", r["c"].astype("S")), "compressed_size": 2}
    return _bodies(_word_rows(s, d), 33, lambda r: (np.concatenate([L.write_many(L.LOG_HEADER, len(r["c"]), fields(r)), _words(r["v"])], 1),), "version long, identifier string, payload_hex string")


@add("c13_performance_fields", f"select o_orderkey as key, w first_word, case when v >= 32768 then v - 65536 else v end signed_word, w::bigint * 65536 + v long_word from {WORDS}")
def c13(s, d):
    b = _bodies(_word_rows(s, d), 3, lambda r: (np.pad(_words(r["w"], r["v"], r["w"], r["v"]), ((0, 0), (0, 952))),), "halfwords array<int>")
    layout = (("first_word", 1, "u16"), ("signed_word", 2, "i16"), ("long_word", 3, "u32"))
    return b.select("key", *[c.alias(n) for n, c in wire.halfword_fields(F.col("halfwords"), layout).items()])


@add("b08_reassembled_segments", f"select o_orderkey as key, 3 n_segments, 6000 n_bytes, 13 message_type, sha256(repeat(chr(c + 32), 3000) || repeat(chr(c + 33), 3000)) digest from {WORDS}")
def b08(s, d):
    m = _messages(s, _word_rows(s, d), lambda r: (13, bytes([r["c"] + 32]) * 3000 + bytes([r["c"] + 33]) * 3000))
    payload = archive.whole_payload(F.col("payloads"))
    return m.select(F.col("volume_id").cast("long").alias("key"), "n_segments", "message_type", payload.alias("p")).select("key", "n_segments", F.length("p").alias("n_bytes"), "message_type", F.sha2("p", 256).alias("digest"))


#: Ten frames an order: orphans, restarts, repeated and missing segments, single ones in between.
_FRAMES = f"(select o_orderkey as key, f, 1 + (o_orderkey // 3 + f * f) % 4 as cnt, 1 + (o_orderkey * 7 + f * (1 + o_orderkey % 3)) % 4 as num, (o_orderkey || '.' || f || ';') payload from {WORDS}, range(10) t(f))"


@add("b08_relational_segments", f"""with x as (select *, sum(case when cnt <= 1 or num = 1 then 1 else 0 end) over (partition by key order by f) run from {_FRAMES}),
 y as (select *, row_number() over (partition by key, run order by f) place, first(cnt) over (partition by key, run order by f) need from x where run > 0)
 select key, min(f)::int first_frame, count(*)::int n_segments, sha256(string_agg(payload, '' order by f)) digest from y where place <= need group by key, run, need having count(*) = need""")
def b08r(s, d):
    """Frames as rows, their messages found by windows."""
    from squall.sources import frames

    k, f = F.col("key"), F.col("f")
    rows = A.words(s, d).select(F.col("o_orderkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("f"))
    rows = rows.select(
        k.cast("string").alias("volume_id"), F.lit(0).alias("record_idx"), f.alias("frame_idx"), F.lit(False).alias("alone"), F.lit(13).alias("message_type"), F.lit(0).alias("channel"), f.alias("sequence"),
        F.lit(1).alias("mjd"), F.lit(0).cast("long").alias("ms"), (1 + (F.floor(k / 3) + f * f) % 4).cast("int").alias("segment_count"), (1 + (k * 7 + f * (1 + k % 3)) % 4).cast("int").alias("segment_number"),
        F.encode(F.concat(k.cast("string"), F.lit("."), f.cast("string"), F.lit(";")), "UTF-8").alias("payload"),
    )
    m = frames.reassemble(rows, 10 * A.words(s, d).count())
    return m.select(F.col("volume_id").cast("long").alias("key"), F.col("sequence").alias("first_frame"), "n_segments", F.sha2(archive.whole_payload(F.col("payloads")), 256).alias("digest"))


@add("b03_split_by_sql", ORACLES["b03_split_records"])
def b03s(s, d):
    """In SQL, by a table function."""
    from squall.sources import frames

    frames.register(s)
    volumes(s, d).createOrReplaceTempView("squall_b03_volumes")
    return s.sql("select v.volume_id, count(*) as n_records, min(r.compressed) as all_compressed from squall_b03_volumes v, lateral squall_records(v.content) r group by v.volume_id")


@add("b07_decode_by_sql", ORACLES["b07_decode_messages"])
def b07s(s, d):
    from squall.sources import frames

    frames.register(s)
    volumes(s, d).createOrReplaceTempView("squall_b07_volumes")
    return s.sql("""select r.volume_id, m.message_type, count(*) as n from (select v.volume_id, r.data from squall_b07_volumes v, lateral squall_records(v.content) r) r, lateral squall_messages(r.data) m
     group by r.volume_id, m.message_type""")


@add("d03_raw_gate_codes", f"select vec_id as key, list_transform(embedding, lambda x: floor(abs(x::double) * 400e0)::int * 100)::varchar codes from {R}")
def d03(s, d):
    r = archive.radials(archive.decode_records(archive.split_volumes(_wide_volumes(s, d))))
    codes = F.concat(F.lit("["), F.array_join(F.col("PHI.raw").cast("array<string>"), ", "), F.lit("]"))
    return r.select(F.floor((F.col("time_ms") % 86_400_000) / 13).alias("key"), codes.alias("codes"))


def _wide_volumes(s, d):
    """Every radial as a sixteen-bit moment, a record each."""

    def work(r):
        raw = [int(abs(float(v)) * 400.0) * 100 for v in r["embedding"]]
        body = archive.radial_bytes({"mjd": 18000, "ms": r["vec_id"] * 13}, {"PHI": {"scale": 1.0, "raw": raw, "word_size": 16}})
        yield {"volume_id": str(r["vec_id"]), "content": archive.volume_bytes([archive.message_bytes(31, body, 18000)])}

    return archive._rows(A.radials(s, d), work, "volume_id string, content binary")


@add("j04_chunk_types", "select event_id, letter, case letter when 'S' then 'Start' when 'E' then 'End' else 'Intermediate' end chunk_type from " + CHUNKS)
def j04(s, d):
    return A.chunks(s, d).select("event_id", "letter", wire.label(F.col("letter"), names.CHUNK_TYPES).alias("chunk_type"))


@add("l04_json_sink", "select label, count(*) n from embeddings group by all")
def l04(s, d):
    """Written as JSON lines and read again."""
    folder = _scratch(s)
    A.read(s, d, "embeddings").select("vec_id", "label").write.json(folder)
    return s.read.schema("vec_id long, label int").json(folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- A: listings ----


@add("a04_latest_volume", f"select site, ts::date::varchar as day, max(name) as name from {ARCHIVES} where name not like '%\\_MDM' escape '\\' group by all")
def a04(s, d):
    l = listing.volumes_only(A.archives(s, d)).withColumn("day", F.to_date("ts").cast("string"))
    return listing.latest(l, ["site", "day"])


@add("a05_as_of_volume", f"""select c_custkey request, max(name) as name from (select c_custkey, 'K' || lpad((c_custkey % 10)::varchar, 3, 'A') site, timestamp '2024-01-03 00:00:00' + c_custkey * interval 97 second as at from customer) q
 left join {ARCHIVES} a on a.site = q.site and a.ts::date = q.at::date and date_trunc('second', a.ts) <= q.at group by all""")
def a05(s, d):
    have = A.archives(s, d).select("site", F.date_trunc("second", F.col("ts")).cast("timestamp").alias("time"), "name")
    q = A.read(s, d, "customer").select(F.col("c_custkey").alias("request"), F.concat(F.lit("K"), F.lpad((F.col("c_custkey") % 10).cast("string"), 3, "A")).alias("site"), F.timestamp_seconds(F.lit(1704240000) + F.col("c_custkey") * 97).alias("at"))
    return listing.as_of(q, have).select("request", "name")


@add("a06_list_prefix", f"select name, strftime(ts, '%Y/%m/%d/') || site || '/' || name as key from {ARCHIVES} where site = 'KAA3' and ts::date = (select min(ts::date) + 2 from events)")
def a06(s, d):
    a = A.archives(s, d)
    day = a.agg(F.date_add(F.min(F.to_date("ts")), 2).cast("string")).first()[0]
    return listing.with_prefix(a, "KAA3", day).select("name", "key")


@add("a07_object_key", f"select name, strftime(ts, '%Y/%m/%d/') || site || '/' || name as key from {ARCHIVES}")
def a07(s, d):
    return A.archives(s, d).select("name", names.archive_key(F.col("name")).alias("key"))


@add("a08_list_objects", f"select event_id // 50 request, name as key, event_id as size, false truncated from {ARCHIVES}")
def a08(s, d):
    item = F.format_string("<Contents><Key>%s</Key><LastModified>2024-01-01T00:00:00.000Z</LastModified><Size>%d</Size></Contents>", "name", "event_id")
    x = A.archives(s, d).groupBy(F.floor(F.col("event_id") / 50).alias("request")).agg(F.concat(F.lit("<ListBucketResult><IsTruncated>false</IsTruncated>"), F.array_join(F.collect_list(item), ""), F.lit("</ListBucketResult>")).alias("body"))
    return listing.parse_object_list(x).drop("modified")


@add("a10_list_chunks", f"select site, count(*) n_chunks, max(sequence) last_sequence from {CHUNKS} group by all")
def a10(s, d):
    c = A.chunks(s, d).withColumn("name", names.chunk_name(F.col("ts"), F.col("sequence"), F.col("letter")))
    p = c.withColumns({k: v for k, v in names.parse_chunk_name(F.col("name")).items() if k != "sequence"} | {"sequence": names.parse_chunk_name(F.col("name"))["sequence"]})
    return p.where("is_valid").groupBy("site").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("sequence").alias("last_sequence"))


_SLOTS = f"(select site, (event_id % 998 + 1) idx, max(epoch_us(ts) // 1000) v from (select user_id site, * from events) group by all)"


def _slots(s, d):
    c = A.chunks(s, d)
    return c.groupBy("site", (F.col("event_id") % 998 + 1).alias("idx")).agg(F.max("time_ms").alias("value"))


@add("a12_newest_slot", f"select site, arg_max(idx, struct_pack(v := v, i := idx)) idx, max(v) as value from {_SLOTS} where idx <= 998 group by all")
def a12(s, d):
    return CH.newest_at_most(_slots(s, d).where(F.col("idx") <= listing.SEARCHED_VOLUMES))


@add("a13_rotated_search", f"select site, arg_max(idx, struct_pack(v := v, i := idx)) idx, max(v) as value from {_SLOTS} where v <= 1705000000000 group by all")
def a13(s, d):
    return CH.newest_at_most(_slots(s, d), F.lit(1705000000000))


@add("a14_sites", f"select c_custkey, id, city, state, latitude, longitude, elevation_m from customer join {SITES} on ord = c_custkey % {len(stations.SITES)}")
def a14(s, d):
    """The registry, a site a customer by its place in it."""
    numbered = stations.sites(s).coalesce(1).withColumn("ord", F.monotonically_increasing_id())  # one partition, so 0, 1, 2, ...
    c = A.read(s, d, "customer").select("c_custkey", (F.col("c_custkey") % len(stations.SITES)).alias("k"))
    return c.join(F.broadcast(numbered), F.col("k") == F.col("ord")).drop("k", "ord")


@add("a15_require_site", f"select c_custkey, id from (select c_custkey, ['KTLX', 'KDMX', 'KFWS'][(c_custkey % 3 + 1)::int] want from customer) c join {SITES} on id = want")
def a15(s, d):
    want = F.element_at(F.array(F.lit("KTLX"), F.lit("KDMX"), F.lit("KFWS")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = A.read(s, d, "customer").select("c_custkey", want.alias("want")).join(stations.sites(s), F.col("want") == F.col("id"), "left")
    return c.select("c_custkey", listing.require_site(F.col("id").isNotNull(), F.col("id")).alias("id"))


@add("d10_site_by_id", f"select c_custkey, id, city from (select c_custkey, ['ktlx', 'KdMx', 'kzzz'][(c_custkey % 3 + 1)::int] want from customer) c join {SITES} on id = upper(want)")
def d10(s, d):
    want = F.element_at(F.array(F.lit("ktlx"), F.lit("KdMx"), F.lit("kzzz")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return A.read(s, d, "customer").select("c_custkey", F.upper(want).alias("want")).join(stations.sites(s), F.col("want") == F.col("id")).select("c_custkey", "id", "city")


@add("d12_known_messages", f"select message_type, count(*) n from (select {wire.label_sql('c', wire.MESSAGE_TYPES)} message_type from {WORDS}) where message_type not like 'Unknown%' group by all")
def d12(s, d):
    m = A.words(s, d).select(wire.label(F.col("c"), wire.MESSAGE_TYPES).alias("message_type"))
    return m.where(~F.col("message_type").startswith("Unknown")).groupBy("message_type").agg(F.count(F.lit(1)).alias("n"))


@add("d14_without_metadata_files", f"select site, count(*) n from {ARCHIVES} where not ends_with(name, '_MDM') group by all")
def d14(s, d):
    return listing.volumes_only(A.archives(s, d)).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


_PLACES = "(select c_custkey, 25e0 + c_custkey % 241 * 0.1e0 lat, -124e0 + c_custkey % 557 * 0.1e0 lon from customer)"


@add("e07_nearest_site", f"""select c_custkey, arg_min(id, struct_pack(d := d, o := ord)) id from (select c_custkey, id, ord, (latitude - lat) * (latitude - lat) + (longitude - lon) * cos(radians((lat + latitude) * 0.5e0)) * (longitude - lon) * cos(radians((lat + latitude) * 0.5e0)) d
 from {_PLACES}, {SITES}) group by all""")
def e07(s, d):
    c = A.read(s, d, "customer").select("c_custkey", (F.lit(25.0) + F.col("c_custkey") % 241 * 0.1).alias("lat"), (F.lit(-124.0) + F.col("c_custkey") % 557 * 0.1).alias("lon"))
    return stations.nearest(c).select("c_custkey", "id")


@add("i04_site_distance", f"select c_custkey, round(power(35.3331e0 - lat, 2) + power((-97.2778e0 - lon) * cos(radians((lat + 35.3331e0) * 0.5e0)), 2), 6) d2 from {_PLACES}")
def i04(s, d):
    c = A.read(s, d, "customer").select("c_custkey", (F.lit(25.0) + F.col("c_custkey") % 241 * 0.1).alias("lat"), (F.lit(-124.0) + F.col("c_custkey") % 557 * 0.1).alias("lon"))
    return c.select("c_custkey", F.round(geo.distance_squared(F.col("lat"), F.col("lon"), 35.3331, -97.2778), 6).alias("d2"))


# ---- B, C: fields ----


@add("b10_message_size", f"select o_orderkey, case when seg < 65535 then seg::bigint * 2 else w::bigint * 65536 + v end size, seg < 65535 and c <> 31 segmented from (select *, case when c % 5 = 0 then 65535 else v end seg from {WORDS})")
def b10(s, d):
    w = A.words(s, d).withColumn("seg", F.when(F.col("c") % 5 == 0, 65535).otherwise(F.col("v")))
    return w.select("o_orderkey", wire.message_size_bytes(F.col("seg"), F.col("w"), F.col("v")).alias("size"), wire.is_segmented(F.col("seg"), F.col("c")).alias("segmented"))


def _label_query(name: str, table: dict, unknown: str = "Unknown({})", code: str = "c"):
    @add(name, f"select label, count(*) n from (select {wire.label_sql(code, table, unknown)} as label from {WORDS}) group by all")
    def run(s, d):
        return A.words(s, d).select(wire.label(F.expr(code), table, unknown).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_label_query("c29_message_types", wire.MESSAGE_TYPES)
_label_query("c29_channels", wire.CHANNELS, code="c % 12")
_label_query("c02_radial_status", wire.RADIAL_STATUS, code="c % 8")
_label_query("c02_compression", wire.COMPRESSION, "FutureUse", "c % 5")
_label_query("c09_rda_status", wire.RDA_STATUS)
_label_query("c09_operability", wire.OPERABILITY)
_label_query("c09_control_status", wire.CONTROL_STATUS)
_label_query("c09_generator_state", wire.GENERATOR_STATE)
_label_query("c09_control_authorization", wire.CONTROL_AUTHORIZATION)
_label_query("c09_operational_mode", wire.OPERATIONAL_MODE)
_label_query("c09_super_resolution", wire.SUPER_RESOLUTION)
_label_query("c09_spot_blanking", wire.SPOT_BLANKING, "Other({})")
_label_query("c09_transition_power", wire.TRANSITION_POWER, "Other({})")
_label_query("c09_rms_control", wire.RMS_CONTROL)
_label_query("c09_performance_check", wire.PERFORMANCE_CHECK)
_label_query("j16_waveforms", wire.WAVEFORM, "Unknown", "c % 8")
_label_query("j16_channel_configuration", wire.CHANNEL_CONFIGURATION, "UnknownPhase", "c % 6")
_label_query("j16_pulse_width", wire.PULSE_WIDTH, "Unknown", "c % 6")


@add("c09_status_numbers", f"""select o_orderkey, w / 100e0 calibration, case when v - 32768 <> 0 then abs(v - 32768) end vcp, v - 32768 < 0 is_local, v % 2 = 0 controlling,
 case c when 0 then 'Disabled' when 1 then 'Enabled' else 'BypassMapElevationSegments(' || array_to_string(list_filter(range(5), lambda i: (c >> i) & 1 = 1), ',') || ')' end clutter from {WORDS}""")
def c09n(s, d):
    w = A.words(s, d)
    signed = F.col("v") - 32768
    return w.select("o_orderkey", (F.col("w") / 100.0).alias("calibration"), F.when(signed != 0, F.abs(signed)).alias("vcp"), (signed < 0).alias("is_local"), (F.col("v") % 2 == 0).alias("controlling"), wire.clutter_mitigation(F.col("c")).alias("clutter"))


@add("c10_build_number", f"""select o_orderkey, case when floor(b + 0.5e0) between 12 and 24 then floor(b + 0.5e0) else b end build, case when floor(b + 0.5e0) between 12 and 24 then floor(b + 0.5e0) else b end < 20 legacy
 from (select *, case when (w % 2600) / 100e0 > 2 then (w % 2600) / 100e0 else (w % 2600) / 10e0 end b from {WORDS})""")
def c10(s, d):
    b = wire.build_number(F.col("w") % 2600)
    return A.words(s, d).select("o_orderkey", b.alias("build"), (b < 20).alias("legacy"))


@add("c11_flag_words", f"select o_orderkey, (w & 1) <> 0 avset_enabled, (w >> 2) & 1 = 1 ebc_enabled, (w >> 3) & 1 = 1 log_data_enabled, (w >> 4) & 1 = 1 time_series_recording, (v >> 6) & 1 = 1 signal_processor, v & 127 = 0 no_alarm from {WORDS}")
def c11(s, d):
    w, v = F.col("w"), F.col("v")
    scan = {n: wire.flag(w, k) for k, n in enumerate(wire.SCAN_FLAGS) if n != "avset_disabled"}
    return A.words(s, d).select("o_orderkey", *[c.alias(n) for n, c in scan.items()], wire.flag(v, 6).alias("signal_processor"), (wire.bits(v, 0, 127) == 0).alias("no_alarm"))


#: Stands for the alarm table, which callers give as a table of code, state, device and message.
_ALARMS = "(select p_partkey::int code, p_type message from part where p_partkey % 3 > 0)"


def alarm_messages(status, definitions):
    """status(key, codes): one row per set code that the definitions know."""
    set_codes = status.select("key", F.posexplode("codes").alias("place", "code")).where("code <> 0")
    return set_codes.join(definitions, "code")


@add("c12_alarm_lookup", f"select key, place, code, message from (select o_orderkey key, generate_subscripts(codes, 1)::int - 1 place, unnest(codes) code from (select o_orderkey, [w % 50, v % 70, c, 0, w % 7] codes from {WORDS})) join {_ALARMS} using (code) where code <> 0")
def c12(s, d):
    status = A.words(s, d).select(F.col("o_orderkey").alias("key"), F.array(F.col("w") % 50, F.col("v") % 70, F.col("c"), F.lit(0), F.col("w") % 7).alias("codes"))
    definitions = A.read(s, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").cast("int").alias("code"), F.col("p_type").alias("message"))
    return alarm_messages(status, definitions).select("key", "place", "code", "message")


@add("c16_pattern_header_bits", f"""select volume_id, cut_no, sequencing_raw & 31 n_elevations, (sequencing_raw >> 5) & 3 max_sails_cuts, (sequencing_raw >> 13) & 1 = 1 sequence_active, (sequencing_raw >> 14) & 1 = 1 truncated,
 flags_raw & 1 = 1 sails, (flags_raw >> 1) & 7 sails_cuts, (flags_raw >> 4) & 1 = 1 mrle, (flags_raw >> 5) & 7 mrle_cuts, (flags_raw >> 11) & 1 = 1 mpda, (flags_raw >> 12) & 1 = 1 base_tilt, (flags_raw >> 13) & 7 base_tilts from {CUTS}""")
def c16(s, d):
    return A.cuts(s, d).select("volume_id", "cut_no", *[c.alias(n) for n, c in wire.vcp_header(F.col("sequencing_raw"), F.col("flags_raw")).items()])


@add("c17_cut_bits", f"""select volume_id, cut_no, sequencing_raw & 1 = 1 half_degree_azimuth, (sequencing_raw >> 1) & 1 = 1 quarter_km_reflectivity, (sequencing_raw >> 2) & 1 = 1 doppler_to_300km, (sequencing_raw >> 3) & 1 = 1 dual_pol_to_300km,
 flags_raw & 1 = 1 sails_cut, (flags_raw >> 1) & 7 sails_sequence, (flags_raw >> 4) & 1 = 1 mrle_cut, (flags_raw >> 5) & 7 mrle_sequence, (flags_raw >> 9) & 1 = 1 mpda_cut, (flags_raw >> 10) & 1 = 1 base_tilt_cut,
 (angle_raw - 32768) / 8e0 ref_threshold from {CUTS}""")
def c17(s, d):
    bits = wire.vcp_cut(F.col("sequencing_raw"), F.col("flags_raw"))
    return A.cuts(s, d).select("volume_id", "cut_no", *[c.alias(n) for n, c in bits.items()], ((F.col("angle_raw") - 32768) / 8.0).alias("ref_threshold"))


@add("c18_angles", f"select volume_id, cut_no, elevation_deg, case when (rate_raw >> 15) & 1 = 1 then -rate else rate end rate from {CUTS}")
def c18(s, d):
    return A.cuts(s, d).select("volume_id", "cut_no", "elevation_deg", (wire.decode_angular_velocity(F.col("rate_raw")) + 0.0).alias("rate"))


@add("c20_censor_regions", f"select o_orderkey, k::int k, ((w + k * 3) % 512) start_range, ((v + k * 5) % 512) stop_range from {WORDS}, range(0, 66) t(k) where k < c % 4")
def c20(s, d):
    region = F.transform(F.sequence(F.lit(0), F.col("c") % 4), lambda k: F.struct(((F.col("w") + k * 3) % 512).alias("start_range"), ((F.col("v") + k * 5) % 512).alias("stop_range")))
    w = A.words(s, d).select("o_orderkey", F.slice(region, F.lit(1), F.col("c") % 4).alias("regions"))
    return w.select("o_orderkey", F.posexplode("regions").alias("k", "r")).select("o_orderkey", "k", "r.start_range", "r.stop_range")


@add("c21_request_bits", "select o_orderkey, " + ", ".join(f"(w & {b}) <> 0 {n}" for n, b in wire.REQUEST_BITS.items()) + f" from {WORDS}")
def c21(s, d):
    return A.words(s, d).select("o_orderkey", *[(F.col("w").bitwiseAND(F.lit(b)) != 0).alias(n) for n, b in wire.REQUEST_BITS.items()])


@add("c23_bypass_flags", f"select o_orderkey, k::int range_bin, (w >> (k % 16)) & 1 = 1 bypass from {WORDS}, range(16) t(k)")
def c23(s, d):
    w = A.words(s, d)
    return w.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("range_bin"), "w").select("o_orderkey", "range_bin", (F.call_function("shiftright", "w", "range_bin").bitwiseAND(F.lit(1)) == 1).alias("bypass"))


@add("c24_clutter_zones", f"""with z as (select o_orderkey key, k, k * 100 + w % 90 end_range, (v + k) % 3 op from {WORDS}, range(1, 5) t(k)), q as (select o_orderkey key, v % 500 r from {WORDS})
 select key, r, arg_min(op, end_range) op from q join z using (key) where r <= end_range group by all""")
def c24(s, d):
    w = A.words(s, d)
    zones = w.select(F.col("o_orderkey").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "w", "v").select("key", (F.col("k") * 100 + F.col("w") % 90).alias("end_range"), ((F.col("v") + F.col("k")) % 3).alias("op"))
    q = w.select(F.col("o_orderkey").alias("key"), (F.col("v") % 500).alias("r"))
    return q.join(zones, "key").where("r <= end_range").groupBy("key", "r").agg(F.min_by("op", "end_range").alias("op"))


@add("c25_site_position", f"""select o_orderkey as key, round((case when c % 2 = 0 then -1e0 else 1e0 end) * (w % 90 + v % 60 / 60e0 + (c + 0.5e0) / 3600e0), 6) latitude, round(-1e0 * (v % 180 + w % 60 / 60e0), 6) longitude,
 'K' || lpad(c::varchar, 3, '0') site_name, w::bigint ground, (v - 30000)::bigint elevation_min, c * 0.25e0 fuel_10, 13 n_atmos, round(c * 0.5e0, 6) last_v_rnscale, w * 1e0 clock, c * 2e0 alarm_threshold from {WORDS}""")
def c25(s, d):
    """Whole adaptation documents, written and decoded: fields from its beginning to its last."""

    def encode(r):
        c, w, v = r["c"], r["w"], r["v"]
        return 18, archive.adaptation_bytes({
            "slatdeg": w % 90, "slatmin": v % 60, "slatsec": c + 0.5, "slatdir": "S" if c % 2 == 0 else "N", "slondeg": v % 180, "slonmin": w % 60, "slonsec": 0.0, "slondir": "W",
            "site_name": f"K{c:03d}", "site_ground_height": w, "ant_manual_setup_iel_min": v - 30000, "a_fuel_conv": [0.0, c * 0.25], "atmos": [0.5] * 13, "v_rnscale": [0.0] * 12 + [c * 0.5],
            "dig_rcvr_clock_freq": float(w), "txb_alarm_thresh": c * 2.0,
        })

    kinds = "site_latitude double, site_longitude double, site_name string, site_ground_height long, ant_manual_setup_iel_min long, a_fuel_conv array<double>, atmos array<double>, v_rnscale array<double>, dig_rcvr_clock_freq double, txb_alarm_thresh double"
    def work(row):
        kind, payload = encode(row)
        data = archive.message_bytes(kind, payload, 18000, row["key"])
        yield {"volume_id": str(row["key"]), "record_idx": 0, "offset": 0, "size": len(data), "compressed": False, "data": data, "_corrupt": None}

    b = archive.record_bodies(archive._rows(_word_rows(s, d), work, archive.RECORDS), kinds, (18,)).select(F.col("volume_id").cast("long").alias("key"), "body.*")
    return b.select(
        "key", F.round("site_latitude", 6).alias("latitude"), F.round("site_longitude", 6).alias("longitude"), "site_name", F.col("site_ground_height").alias("ground"), F.col("ant_manual_setup_iel_min").alias("elevation_min"),
        F.col("a_fuel_conv")[1].alias("fuel_10"), F.size("atmos").alias("n_atmos"), F.round(F.col("v_rnscale")[12], 6).alias("last_v_rnscale"), F.col("dig_rcvr_clock_freq").alias("clock"), F.col("txb_alarm_thresh").alias("alarm_threshold"),
    )


# ---- E, F, G: streams of messages and chunks ----


def _sql_chunk_map() -> str:
    return f"""(with n as (select *, case when half_degree then 6 else 3 end n from {CUTS}), q as (select *, coalesce(sum(n) over (partition by volume_id order by cut_no rows between unbounded preceding and 1 preceding), 0) + 2 start_seq from n),
 r as (select volume_id, start_seq + k "sequence", cut_no elevation_number, k chunk_index, n chunks_in_sweep, k = 0 is_first, k = n - 1 is_last, rate, elevation_deg, false is_start, start_seq, start_seq + n - 1 end_seq from q, range(6) t(k) where k < n)
 select * from r union all select distinct volume_id, 1, null, 0, 1, false, false, 0e0, 0e0, true, null, null from q)"""


_MAP = _sql_chunk_map()


@add("g06_chunk_map", f'select volume_id, "sequence"::int "sequence", elevation_number::int elevation_number, chunk_index::int chunk_index, chunks_in_sweep::int chunks_in_sweep, is_first, is_last, rate, elevation_deg, is_start from {_MAP}')
def g06(s, d):
    return CH.chunk_map(A.cuts(s, d))


@add("e05_chunk_to_cut", f'select c.volume_id, c."sequence"::int "sequence", m.elevation_number::int elevation_number from (select p_partkey // 20 volume_id, p_partkey % 97 + 1 "sequence" from part) c left join {_MAP} m on c.volume_id = m.volume_id and c."sequence" = m."sequence"')
def e05(s, d):
    m = CH.chunk_map(A.cuts(s, d)).where("not is_start")
    ranges = m.groupBy("volume_id", "elevation_number").agg(F.min("sequence").alias("start_seq"), F.max("sequence").alias("end_seq"))
    c = A.read(s, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("volume_id"), (F.col("p_partkey") % 97 + 1).cast("int").alias("sequence"))
    return CH.cut_of_chunk(c, ranges).select("volume_id", "sequence", "elevation_number")


@add("e06_chunk_characteristics", f"""select m.volume_id, m."sequence"::int "sequence", {wire.label_sql('c.waveform_raw', wire.WAVEFORM, 'Unknown')} waveform, {wire.label_sql('c.channel_raw', wire.CHANNEL_CONFIGURATION, 'UnknownPhase')} phase
 from {_MAP} m join {CUTS} c on m.volume_id = c.volume_id and m.elevation_number = c.cut_no""")
def e06(s, d):
    c = A.cuts(s, d)
    m = CH.chunk_map(c).select("volume_id", "sequence", "elevation_number")
    k = c.select(F.col("volume_id").alias("_v"), "cut_no", wire.label(F.col("waveform_raw"), wire.WAVEFORM, "Unknown").alias("waveform"), wire.label(F.col("channel_raw"), wire.CHANNEL_CONFIGURATION, "UnknownPhase").alias("phase"))
    return m.join(k, (F.col("volume_id") == F.col("_v")) & (F.col("elevation_number") == F.col("cut_no"))).select("volume_id", "sequence", "waveform", "phase")


@add("e11_semi_anti", f"""select volume_id, message_type, ordinal from {MESSAGES} m where elevation_number = 1 and exists (select 1 from {MESSAGES} x where x.volume_id = m.volume_id and x.message_type = 'RDAStatusData')
 and not exists (select 1 from {MESSAGES} x where x.volume_id = m.volume_id and x.message_type = 'RDALogData' and x.ordinal = m.ordinal + 1)""")
def e11(s, d):
    m = A.messages(s, d)
    status = m.where("message_type = 'RDAStatusData'").select("volume_id")
    log = m.where("message_type = 'RDALogData'").select("volume_id", (F.col("ordinal") - 1).alias("ordinal"))
    return m.where("elevation_number = 1").join(status, "volume_id", "left_semi").join(log, ["volume_id", "ordinal"], "left_anti").select("volume_id", "message_type", "ordinal")


_RUNS = f"""(with m as (select *, case when message_type = 'RDADigitalRadarDataGenericFormat' then elevation_number end e from {MESSAGES}),
 f as (select *, case when lag(message_type) over w = message_type and lag(e) over w is not distinct from e and message_type not in ('RDAStatusData', 'RDAVolumeCoveragePattern') then 0 else 1 end nw from m window w as (partition by volume_id order by ordinal)),
 r as (select *, sum(nw) over (partition by volume_id order by ordinal) run from f)
 select volume_id, run::bigint run, min(message_type) message_type, min(e) elevation_number, count(*) message_count, min(ordinal) first_ordinal, max(ordinal) last_ordinal, arg_min(time_ms, ordinal) start_ms, arg_max(time_ms, ordinal) end_ms, count(reflectivity) n_reflectivity from r group by volume_id, run)"""


@add("f08_message_groups", f"select volume_id, run, message_type, elevation_number, message_count, first_ordinal, last_ordinal, start_ms, end_ms from {_RUNS}")
def f08(s, d):
    return summaries.message_groups(A.messages(s, d)).drop("is_continued")


@add("f09_data_counts", f"select volume_id, run, n_reflectivity from {_RUNS} where message_type = 'RDADigitalRadarDataGenericFormat'")
def f09(s, d):
    g = summaries.message_groups(A.messages(s, d), counts=("reflectivity",))
    return g.where(F.col("message_type") == summaries.RADIAL).select("volume_id", "run", "n_reflectivity")


@add("f10_continued", f"select volume_id, run, message_type = 'RDADigitalRadarDataGenericFormat' and row_number() over (partition by volume_id, message_type, elevation_number order by run) > 1 is_continued from {_RUNS}")
def f10(s, d):
    return summaries.message_groups(A.messages(s, d)).select("volume_id", "run", "is_continued")


@add("f08_collection_times", f"select volume_id, min(time_ms) filter (message_type in ('RDADigitalRadarDataGenericFormat', 'RDAStatusData') and time_ms > 0) earliest_ms, max(time_ms) filter (message_type in ('RDADigitalRadarDataGenericFormat', 'RDAStatusData')) latest_ms from {MESSAGES} group by all")
def f08b(s, d):
    return A.messages(s, d).groupBy("volume_id").agg(*[c.alias(n) for n, c in summaries.collection_times(A.messages(s, d)).items()])


@add("f11_status_flags", f"select o_orderkey, array_to_string(list_filter([case when w & 1 <> 0 then 'avset' end, case when w & 4 <> 0 then 'ebc' end, case when w & 8 <> 0 then 'log' end, case when w & 16 <> 0 then 'recording' end], lambda x: x is not null), ',') flags from {WORDS}")
def f11(s, d):
    w = F.col("w")
    return A.words(s, d).select("o_orderkey", F.array_join(summaries.set_flags(avset=wire.flag(w, 0), ebc=wire.flag(w, 2), log=wire.flag(w, 3), recording=wire.flag(w, 4)), ",").alias("flags"))


def _samples(s, d):
    c = A.chunks(s, d)
    w = Window.partitionBy("site").orderBy("sequence")
    return c.select(
        "event_id", F.col("letter").alias("chunk_type"), wire.label((F.col("site") % 6).cast("int"), wire.WAVEFORM, "Unknown").alias("waveform"), wire.label((F.col("site") % 4).cast("int"), wire.CHANNEL_CONFIGURATION, "UnknownPhase").alias("phase"),
        F.col("event_id").alias("ts"), (F.col("time_ms") - F.lag("time_ms").over(w)).alias("ms"), (F.col("event_id") % 5 + 1).alias("attempts"),
    ).where("ms is not null")


_SAMPLES = f"""(select * from (select event_id, letter chunk_type, {wire.label_sql('(site % 6)::int', wire.WAVEFORM, 'Unknown')} waveform, {wire.label_sql('(site % 4)::int', wire.CHANNEL_CONFIGURATION, 'UnknownPhase')} phase,
 time_ms - lag(time_ms) over (partition by site order by "sequence") ms, event_id % 5 + 1 attempts from {CHUNKS}) where ms is not null)"""


@add("f12_timing_history", f"""select event_id, (sum(ms) over w // count(*) over w)::bigint average_ms, round(avg(attempts) over w, 6) average_attempts, count(*) over w n_samples from {_SAMPLES}
 window w as (partition by chunk_type, waveform, phase order by event_id rows between 9 preceding and current row)""")
def f12(s, d):
    return CH.timing_history(_samples(s, d)).select("event_id", "average_ms", F.round("average_attempts", 6).alias("average_attempts"), "n_samples")


@add("f13_timing_statistics", f"""select chunk_type, waveform, phase, (sum(ms) // count(*))::bigint average_ms, round(avg(attempts), 6) average_attempts, count(*) n_samples from (select *, row_number() over (partition by chunk_type, waveform, phase order by event_id desc) k from {_SAMPLES}) where k <= 10 group by all""")
def f13(s, d):
    return CH.timing_statistics(_samples(s, d)).select("chunk_type", "waveform", "phase", "average_ms", F.round("average_attempts", 6).alias("average_attempts"), "n_samples")


def _sweeps(s, d):
    return A.chunks(s, d).groupBy(F.col("site").alias("volume_id"), (F.col("site") % 8).alias("pattern"), F.floor((F.col("sequence") - 1) / 6).alias("sweep_idx")).agg(F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))


_SWEEPS = f'(select site volume_id, site % 8 pattern, ("sequence" - 1) // 6 sweep_idx, min(time_ms) first_ms, max(time_ms) last_ms from {CHUNKS} group by all)'


@add("g04_sweep_gaps", f"select volume_id, sweep_idx, lead(first_ms) over (partition by volume_id order by sweep_idx) - last_ms gap_ms from {_SWEEPS}")
def g04(s, d):
    return summaries.sweep_gaps(_sweeps(s, d)).select("volume_id", "sweep_idx", "gap_ms")


@add("f14_timing_by_pattern", f"""with g as (select *, lead(first_ms) over (partition by volume_id order by sweep_idx) - last_ms gap, last_ms - first_ms sweep from {_SWEEPS}),
 v as (select pattern, volume_id, max(last_ms) - min(first_ms) volume from g group by all)
 select pattern, n_volumes, min_volume_ms, round(mean_volume_ms, 3) mean_volume_ms, max_volume_ms, min_sweep_ms, round(mean_sweep_ms, 3) mean_sweep_ms, max_sweep_ms, min_gap_ms, round(mean_gap_ms, 3) mean_gap_ms, max_gap_ms
 from (select pattern, count(*) n_volumes, min(volume) min_volume_ms, avg(volume) mean_volume_ms, max(volume) max_volume_ms from v group by all)
 join (select pattern, min(sweep) min_sweep_ms, avg(sweep) mean_sweep_ms, max(sweep) max_sweep_ms, min(gap) min_gap_ms, avg(gap) mean_gap_ms, max(gap) max_gap_ms from g group by all) using (pattern)""")
def f14(s, d):
    t = summaries.timing_by_pattern(_sweeps(s, d))
    return t.withColumns({n: F.round(n, 3) for n in ("mean_volume_ms", "mean_sweep_ms", "mean_gap_ms")})


_INTERVAL = """case when is_start then 8.5e0 when is_first then coalesce(case when rate > 0 then (360e0 / rate - 0.67e0) / chunks_in_sweep end, 4e0) + (0.7e0 + abs(elevation_deg - lag(elevation_deg) over w) * 0.08e0)
 else coalesce(case when rate > 0 then (360e0 / rate - 0.67e0) / chunks_in_sweep end, 4e0) end"""
_PROJECTED = f"""(select *, sum(interval_ms) over (partition by volume_id order by "sequence") offset_ms from (select volume_id, "sequence", trunc({_INTERVAL} * 1000e0)::bigint interval_ms from {_MAP} window w as (partition by volume_id order by "sequence")) where "sequence" > 1)"""


@add("g05_scan_projection", f'select volume_id, "sequence"::int "sequence", interval_ms, offset_ms::bigint offset_ms from {_PROJECTED}')
def g05(s, d):
    return CH.project(CH.chunk_map(A.cuts(s, d))).select("volume_id", "sequence", "interval_ms", "offset_ms")


@add("m10_blended_projection", f"""select volume_id, "sequence"::int "sequence", trunc((x * 0.7e0 + 5000 / 1000e0 * 0.3e0) * 1000e0)::bigint interval_ms from (select volume_id, "sequence", {_INTERVAL} x from {_MAP} window w as (partition by volume_id order by "sequence")) where "sequence" > 1""")
def m10(s, d):
    m = CH.chunk_map(A.cuts(s, d)).withColumn("history", F.lit(5000).cast("long"))
    return CH.project(m, history_ms="history").select("volume_id", "sequence", "interval_ms")


@add("m10_volume_end", f'select volume_id, max(offset_ms)::bigint remaining_ms, max("sequence")::int final_sequence from {_PROJECTED} group by all')
def m10b(s, d):
    return CH.volume_end(CH.project(CH.chunk_map(A.cuts(s, d))))


@add("m06_processing_wait", f"""select event_id, case when chunk_type = 'S' then 8500 when event_id % 3 = 0 then ms + (trunc(attempts * 1.5e0)::bigint - 1) * 1000 when event_id % 3 = 1 then trunc((event_id % 50 * 0.1e0) * 1000e0)::bigint
 else (case when waveform = 'CS' then 11 when phase = 'ConstantPhase' then 7 else 4 end) * 1000 end wait_ms from {_SAMPLES}""")
def m06(s, d):
    x = _samples(s, d)
    k = F.col("event_id") % 3
    wait = timing.processing_wait_ms(F.col("chunk_type") == "S", F.when(k == 0, F.col("ms")), F.when(k == 0, F.col("attempts") * 1.5), F.when(k == 1, F.col("event_id") % 50 * 0.1), F.col("waveform"), F.col("phase"))
    return x.select("event_id", wait.alias("wait_ms"))


@add("m08_retry_delays", "select event_id, policy, case when a < most then case when a = 0 then 500 else least(trunc(500e0 * pow(2e0, greatest(a - 1, 0)))::bigint, cap) end end delay_ms from (select event_id, event_id % 12 a from events), (values ('download', 5, 8000::bigint), ('discovery', 10, 16000::bigint)) p(policy, most, cap)")
def m08(s, d):
    """Events as attempts: what each policy waits before the next."""
    a = A.read(s, d, "events").select("event_id", (F.col("event_id") % 12).cast("int").alias("attempt"))
    both = [a.select("event_id", F.lit(n).alias("policy"), timing.retry_delay_ms(F.col("attempt"), p).alias("delay_ms")) for n, p in (("download", timing.DOWNLOAD_RETRY), ("discovery", timing.DISCOVERY_RETRY))]
    return both[0].unionByName(both[1])


@add("i08_durations", f"select volume_id, cut_no, case when rate > 0 then round(360e0 / rate - 0.67e0, 9) end sweep_s, case when rate > 0 then round((360e0 / rate - 0.67e0) / 6, 9) end chunk_s, round(0.7e0 + abs(elevation_deg - 0.5e0) * 0.08e0, 10) gap_s from {CUTS}")
def i08(s, d):
    c = A.cuts(s, d)
    return c.select("volume_id", "cut_no", F.round(timing.sweep_duration(F.col("rate")), 9).alias("sweep_s"), F.round(timing.chunk_duration(F.col("rate"), F.lit(6)), 9).alias("chunk_s"), F.round(timing.sweep_gap(F.lit(0.5), F.col("elevation_deg")), 10).alias("gap_s"))


@add("h03_last_identifier", f"select site, max(name) as name from {ARCHIVES} group by all")
def h03(s, d):
    return listing.latest(A.archives(s, d), ["site"])


@add("h07_distinct_patterns", f"select distinct waveform_raw, channel_raw from {CUTS}")
def h07(s, d):
    return A.cuts(s, d).select("waveform_raw", "channel_raw").distinct()


@add("h08_intersect_sweeps", f"select elevation_number from (select elevation_number from {MESSAGES} where message_type = 'RDADigitalRadarDataGenericFormat' intersect select elevation_number from {MESSAGES} where message_type = 'RDALogData')")
def h08(s, d):
    m = A.messages(s, d)
    return m.where(F.col("message_type") == summaries.RADIAL).select("elevation_number").intersect(m.where("message_type = 'RDALogData'").select("elevation_number"))


@add("h09_max_keys", f"select name from {ARCHIVES} order by name limit 100")
def h09(s, d):
    return A.archives(s, d).select("name").orderBy("name").limit(100)


# ---- J: strings and dates ----


@add("j01_archive_names", f"select name, site, (epoch_us(date_trunc('second', ts)) // 1000) time_ms from {ARCHIVES}")
def j01(s, d):
    a = A.archives(s, d)
    return a.select("name", names.archive_site(F.col("name")).alias("site"), F.unix_millis(names.archive_time(F.col("name"))).alias("time_ms"))


@add("j02_chunk_names", f"""select event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || lpad("sequence"::varchar, 3, '0') || '-' || letter as name from {CHUNKS}""")
def j02(s, d):
    return A.chunks(s, d).select("event_id", names.chunk_name(F.col("ts"), F.col("sequence"), F.col("letter")).alias("name"))


@add("j03_parse_chunk_names", f"""select event_id, (epoch_us(date_trunc('second', ts)) // 1000) prefix_ms, "sequence"::int "sequence", case letter when 'S' then 'Start' when 'E' then 'End' else 'Intermediate' end chunk_type, true is_valid from {CHUNKS}""")
def j03(s, d):
    c = A.chunks(s, d).select("event_id", names.chunk_name(F.col("ts"), F.col("sequence"), F.col("letter")).alias("name"))
    p = c.select("event_id", *[v.alias(k) for k, v in names.parse_chunk_name(F.col("name")).items()])
    return p.select("event_id", F.unix_millis("prefix_time").alias("prefix_ms"), "sequence", "chunk_type", "is_valid")


@add("j05_next_chunk", f"""select event_id, "sequence" = 50 next_volume, case when "sequence" <> 50 then "sequence" + 1 end next_sequence, case when "sequence" + 1 = 50 then 'E' when "sequence" <> 50 then 'I' end next_type from {CHUNKS}""")
def j05(s, d):
    return A.chunks(s, d).select("event_id", *[v.alias(k) for k, v in names.next_chunk(F.col("sequence"), F.lit(50)).items()])


@add("j06_next_volume", f"select o_orderkey, (w % 999 + 1) % 999 + 1 next from {WORDS}")
def j06(s, d):
    return A.words(s, d).select("o_orderkey", names.next_volume(F.col("w") % 999 + 1).alias("next"))


@add("j07_julian_dates", f"select o_orderkey, (w::bigint - 1) * 86400000 + v * 1000 time_ms from {WORDS}")
def j07(s, d):
    return A.words(s, d).select("o_orderkey", F.unix_millis(wire.mjd_timestamp(F.col("w"), F.col("v") * 1000)).alias("time_ms"))


@add("j08_pattern_descriptions", f"select o_orderkey, {wire.label_sql('w % 220', wire.VCP_DESCRIPTIONS, 'Unknown')} as description, case when (w % 220) in (12, 31, 32, 35, 112, 212, 215) then 'VCP ' || (w % 220) || ' (' || {wire.label_sql('w % 220', wire.VCP_DESCRIPTIONS, 'Unknown')} || ')' else 'VCP ' || (w % 220) end shown from {WORDS}")
def j08(s, d):
    n = F.col("w") % 220
    text = wire.label(n, wire.VCP_DESCRIPTIONS, "Unknown")
    shown = F.when(text == "Unknown", F.format_string("VCP %d", n)).otherwise(F.format_string("VCP %d (%s)", n, text))
    return A.words(s, d).select("o_orderkey", text.alias("description"), shown.alias("shown"))


@add("j09_display_site", f"select c_custkey, id || ' (' || city || ', ' || state || ')' shown from customer join {SITES} on ord = c_custkey % {len(stations.SITES)}")
def j09(s, d):
    return a14(s, d).select("c_custkey", display.site(F.col("id"), F.col("city"), F.col("state")).alias("shown"))


@add("j10_text_decode", "select doc_id, length(text) n_chars, null::bigint n_broken, length(text) + 2 n_lossy from documents")
def j10(s, d):
    """Strict decoding of good and of broken bytes (one byte that is no UTF-8 on either side), and lossy decoding."""
    good = F.encode("text", "UTF-8")
    broken = F.concat(F.lit(b"\xff"), good, F.lit(b"\xfe"))
    length = lambda x: F.length(x).cast("long")
    r = A.read(s, d, "documents")
    return r.select("doc_id", length(display.text(good)).alias("n_chars"), length(display.text(broken)).alias("n_broken"), length(display.text(broken, lossy=True)).alias("n_lossy"))


@add("j11_trimmed_strings", "select p_partkey, p_brand as brand from part")
def j11(s, d):
    padded = F.encode(F.concat("p_brand", F.lit("  "), F.lit("\0\0")), "UTF-8")
    return A.read(s, d, "part").select("p_partkey", display.trimmed(padded).alias("brand"))


@add("j12_binary_digest", "select doc_id, octet_length(encode(text)) n_bytes, sha256(text) sha256, lower(hex(encode(text)[1:4])) head from documents")
def j12(s, d):
    b = F.encode("text", "UTF-8")
    return A.read(s, d, "documents").select("doc_id", F.length(b).cast("long").alias("n_bytes"), F.sha2(b, 256).alias("sha256"), F.lower(F.hex(F.substring(b, 1, 4))).alias("head"))


@add("f17_moment_digest", f"select sweep_idx, sha256(string_agg(lpad(hex(raw), 2, '0'), '' order by az_idx, gate_idx)) digest from {RAW} group by all")
def f17(s, d):
    codes = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 400.0).cast("long")), 2, "0"))
    r = A.radials(s, d).select("sweep_idx", "az_idx", F.encode(F.array_join(codes, ""), "UTF-8").alias("data"))
    return digests.in_order(r, ["sweep_idx"], ["az_idx"], "data").select("sweep_idx", "digest")


@add("j13_timing_json", f"""select volume_id, '{{"volume_id":' || volume_id || ',"n":' || count(*) || ',"first_ms":' || min(first_ms) || '}}' as json from {_SWEEPS} group by volume_id""")
def j13(s, d):
    g = _sweeps(s, d).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), F.min("first_ms").alias("first_ms"))
    return g.select("volume_id", F.to_json(F.struct("volume_id", "n", "first_ms")).alias("json"))


@add("j14_json_round_trip", f"select volume_id, cut_no, elevation_deg, half_degree from {CUTS}")
def j14(s, d):
    c = A.cuts(s, d).select(F.to_json(F.struct("volume_id", "cut_no", "elevation_deg", "half_degree")).alias("j"))
    return c.select(F.from_json("j", "volume_id bigint, cut_no bigint, elevation_deg double, half_degree boolean").alias("x")).select("x.*")


@add("j15_hex_dump", "select doc_id, k::int as line, upper(hex(encode(text)[k * 16 + 1 : k * 16 + 16])) dump from (select doc_id, text, unnest(range((octet_length(encode(text)) + 15) // 16)) k from documents)")
def j15(s, d):
    r = A.read(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return display.hex_lines(r, "data").select("doc_id", "line", "dump")


# ---- M: streams ----


@add("m05_tracked_chunks", f"""select site, "sequence"::int "sequence", chunk_type, time_ms, interval_ms, case when n > 0 then (total // n)::bigint end average_ms, n::int n_samples from (select *, count(interval_ms) over w n, sum(interval_ms) over w total from
 (select site::varchar site, "sequence", case letter when 'S' then 'Start' when 'E' then 'End' else 'Intermediate' end chunk_type, time_ms, time_ms - lag(time_ms) over (partition by site order by time_ms, "sequence") interval_ms from {CHUNKS})
 window w as (partition by site, chunk_type order by time_ms, "sequence" rows between 9 preceding and current row))""")
def m05(s, d):
    return _tracked(s, d, None).where("event = 'chunk'").select("site", "sequence", "chunk_type", "time_ms", "interval_ms", "average_ms", "n_samples")


def _tracked(s, d, delay):
    """Every site's chunks through its state, from a stream of files."""
    from squall.streaming import chunk_stream, site_state

    numbered = A.chunks(s, d).select(F.col("site").cast("string").alias("site"), F.lit(1).alias("volume"), "sequence", wire.label(F.col("letter"), names.CHUNK_TYPES).alias("chunk_type"), "time_ms")
    folder = _scratch(s)
    numbered.write.parquet(f"{folder}/chunks")
    stream = s.readStream.schema(numbered.schema).parquet(f"{folder}/chunks")
    return chunk_stream.run_to_end(site_state.track(stream, delay), f"tracked_{uuid.uuid4().hex}", f"{folder}/state")


_WAITING = f"""(select *, case letter when 'S' then 8500 else coalesce((total // nullif(n, 0))::bigint, 4000) end + time_ms expected_ms, lead(time_ms) over (partition by site order by time_ms, "sequence") next_ms from
 (select *, count(interval_ms) over w n, sum(interval_ms) over w total from (select *, time_ms - lag(time_ms) over (partition by site order by time_ms, "sequence") interval_ms from {CHUNKS})
 window w as (partition by site, letter order by time_ms, "sequence" rows between 9 preceding and current row)))"""


@add("m05_overdue", f"""select site::varchar site, "sequence"::int "sequence", case letter when 'S' then 'Start' when 'E' then 'End' else 'Intermediate' end chunk_type, time_ms, expected_ms from {_WAITING}
 where next_ms > expected_ms or next_ms is null and expected_ms <= (select max(time_ms) - 600000 from {_WAITING})""")
def m05o(s, d):
    """Chunks whose next one came late or not at all, told by timers of event time."""
    return _tracked(s, d, "10 minutes").where("event = 'overdue'").select("site", "sequence", "chunk_type", "time_ms", "expected_ms")


def _scratch(s) -> str:
    """A new folder that executors share: beside the checkpoints; of this machine only where Spark runs on it alone."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        where = s.sparkContext._jsc.sc().getCheckpointDir()
        base = where.get() if where.isDefined() else None
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="squall-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


@add("m01_windowed_stream", "select time_bucket(interval 1 hour, ts) ts, event_type, count(*) n from events group by all")
def m01(s, d):
    e = A.read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = _scratch(s)
    e.write.parquet(f"{folder}/events")
    stream = s.readStream.schema(e.schema).parquet(f"{folder}/events").withWatermark("ts", "40 days")
    from squall.streaming import chunk_stream

    counted = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = chunk_stream.run_to_end(counted, f"windowed_{uuid.uuid4().hex}", f"{folder}/state", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("ts"), "event_type", "n")


_PARTS = f"""(select *, dense_rank() over (partition by volume_id order by label) r from (select {VOLUME} volume_id, label % 2 k, vec_id // {BLOCK} * 2 + label % 2 n, label from embeddings))"""
_ASSEMBLED = f"""(select volume_id || '-1' volume_id, n, (count(distinct label) + 1 - lost::int)::int n_records, count(*) filter (not lost or r <> 3) n_radials, count(distinct label) + 1 - lost::int n_chunks,
 case when lost and max(r) > 3 then '4' else '' end missing, not lost complete from (select *, k = 1 and max(r) over (partition by volume_id) >= 3 lost from {_PARTS}) group by volume_id, n, lost)"""


def _feed(s, d):
    """Volumes cut into chunks, each a site's: of odd ones the fourth chunk never comes, of others the second comes twice."""
    c = archive.cut_chunks(volumes(s, d)).withColumnRenamed("volume_id", "site")
    own = F.split("site", "-")
    n = own[1].cast("long") * 2 + F.substring(own[0], 2, 1).cast("long")
    odd = F.substring("site", 2, 1) == "1"
    times = F.when(odd & (F.col("sequence") == 4), 0).when(~odd & (F.col("sequence") == 2), 2).otherwise(1)
    c = c.withColumn("time", F.explode(F.array_repeat(F.lit(0), times)))
    return c.select("site", F.lit(1).alias("volume"), "sequence", "chunk_type", (n * 100_000 + F.col("sequence") * 1000).alias("time_ms"), "data")


def _told(whole):
    n = archive.split_volumes(whole).groupBy(F.col("volume_id").alias("rv")).agg(F.count(F.lit(1)).cast("int").alias("n_records"))
    r = archive.scan(whole).groupBy(F.col("volume_id").alias("sv")).agg(F.count(F.lit(1)).alias("n_radials"))
    told = whole.select("volume_id", "n_chunks", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), "complete")
    return told.join(n, F.col("volume_id") == F.col("rv")).join(r, F.col("volume_id") == F.col("sv")).select("volume_id", "n_records", "n_radials", "n_chunks", "missing", "complete")


@add("m07_assemble_volume", f"select * exclude (n) from {_ASSEMBLED}")
def m07(s, d):
    """Volumes put together from a table of what has arrived."""
    from squall.streaming import chunk_stream

    return _told(chunk_stream.assemble(_feed(s, d)))


@add("m07_stream_assembly", f"select * exclude (n) from {_ASSEMBLED}")
def m07s(s, d):
    """The same from a stream: complete volumes at their End chunk, others by a timer, when time has gone on."""
    from squall.streaming import assembly, chunk_stream

    folder, c = _scratch(s), _feed(s, d)
    c.repartition(8, F.xxhash64("sequence", "site")).write.parquet(f"{folder}/chunks")
    written = s.read.schema(c.schema).parquet(f"{folder}/chunks")
    later = written.agg((F.max("time_ms") + 1_000_000).alias("time_ms")).select(F.lit("later").alias("site"), F.lit(1).alias("volume"), F.lit(1).alias("sequence"), F.lit("Start").alias("chunk_type"), "time_ms", F.lit(b"").alias("data"))
    later.write.mode("append").parquet(f"{folder}/chunks")
    stream = s.readStream.schema(c.schema).parquet(f"{folder}/chunks")
    return _told(chunk_stream.run_to_end(assembly.assemble_stream(stream, "0 seconds", 50_000), f"assembled_{uuid.uuid4().hex}", f"{folder}/state"))
