"""Readers and writers round trip; streams agree with batch."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from splicelake.operators import ranges
from splicelake.sources import bam, sinks, text
from splicelake.streaming import sessions as ST

REFS = [("chr1", 100_000), ("chr2", 50_000)]


@pytest.mark.parametrize("block", [60_000, 700, 97])
def test_bam(spark, tmp_path, block):
    rng = random.Random(block)
    recs, want = [], []
    for i in range(400):
        n = rng.randint(1, 80)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        ref, pos = rng.choice([(0, 500 + i), (1, i), (-1, -1)])
        cigar = [(n, "M")] if ref >= 0 else []
        tags = {"NH": i, "ts": "+"} if i % 2 else {}
        recs.append(bam.encode_record(f"read{i}", 0 if ref >= 0 else 4, ref, pos, 60, cigar, seq, tags))
        want.append((f"read{i}", REFS[ref][0] if ref >= 0 else None, pos if pos >= 0 else None, f"{n}M" if cigar else "*", seq, str(i) if i % 2 else None))
    path = str(tmp_path / "x.bam")
    bam.write_bam(path, REFS, recs, block)
    for split in (64 << 20, 1500):
        df = bam.read_bam(spark, path, split)
        got = df.select("read_name", "chrom", "start", "cigar", "seq", F.try_element_at("tags", F.lit("NH")))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), split
    al = bam.alignments(bam.read_bam(spark, path))
    r = al.where("read_name = 'read1' OR is_mapped").orderBy("read_name").first()
    assert r["weight"] is not None
    assert al.where("NOT is_mapped AND exons IS NOT NULL").count() == 0


SAM = """@HD\tVN:1.6
r1\t16\tchr1\t101\t60\t50M10N40M5S\t*\t0\t0\t*\t*\tNH:i:2\tts:A:+\tNM:i:3\tAS:i:90
r1\t256\tchr1\t1101\t0\t90M\t*\t0\t0\t*\t*\tNH:i:2\tAS:i:60
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
r3\t0\tchr2\t1\t60\t5M\t*\t0\t0\tACGTA\t*
"""


def test_sam(spark, tmp_path):
    p = tmp_path / "x.sam"
    p.write_text(SAM)
    df = text.read_sam(spark, str(p))
    r = df.where("read_name = 'r1' AND is_primary").first()
    assert [tuple(e) for e in r["exons"]] == [(100, 150), (160, 200)] and r["end"] == 200
    assert (r["strand"], r["nh"], r["weight"], r["edits"], r["reverse"]) == (-1, 2, 0.5, 4, True)
    assert rows(text.usable(df).select("read_name", "start")) == [("r1", 100), ("r1", 1100)]
    assert text.usable(df, primary=True, chrom="chr1").count() == 1 and text.usable(df, min_span=1, skip=("chr1",)).count() == 1
    assert text.score_margin(df, 10).count() == 3 and text.score_margin(df, 0.6, ratio=True).count() == 4
    need = spark.createDataFrame([("r3",), ("r3",), ("zz",)], "read_name string")
    assert rows(text.primary_sequences(df, need)) == [("r3", "ACGTA")]


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">a one\nACgt\nNN\n>b\nTTTT\n>c\n")
    c = text.read_fasta(spark, str(p))
    assert rows(c) == [("a", "ACGTNN"), ("b", "TTTT"), ("c", "")]
    assert rows(text.tile(c.where("name = 'a'"), 4, overlap=1)) == [("a", 0, "ACGTN"), ("a", 4, "NN")]
    q = spark.createDataFrame([("a", 1, 3), ("a", 4, 99), ("b", -5, 2)], "chrom string, start long, end long")
    assert rows(text.fetch(c, q).select("start", "seq")) == [(-5, "TT"), (1, "CG"), (4, "NN")]


def test_gtf_round_trip(spark, tmp_path):
    data = [("t1", "g1", "c", "+", [(9, 20), (29, 40)], 1.5), ("t2", "g1", "c", "-", [(5, 9)], 2.0)]
    tx = spark.createDataFrame(data, "tx_id string, gene_id string, chrom string, strand string, exons array<struct<start:bigint,end:bigint>>, coverage double")
    out = str(tmp_path / "o.gtf")
    sinks.write_gtf(tx, out)
    lines = [ln for f in sorted((tmp_path / "o.gtf").glob("part*")) for ln in f.read_text().splitlines()]
    assert [ln.split("\t")[2:5] for ln in lines] == [["transcript", "6", "9"], ["exon", "6", "9"], ["transcript", "10", "40"], ["exon", "10", "20"], ["exon", "30", "40"]]
    assert 'cov "1.500000"' in lines[2] and 'exon_number "2"' in lines[4]
    back = text.read_gtf(spark, out)
    assert [(r[0], r[1], r[2], [tuple(e) for e in r[3]]) for r in back.select("transcript_id", "gene_id", "strand", "exons").orderBy("transcript_id").collect()] == [
        ("t1", "g1", "+", [(9, 20), (29, 40)]), ("t2", "g1", "-", [(5, 9)]),
    ]
    assert rows(text.reference_junctions(back)) == [("c", "+", 20, 29, ["t1"], ["g1"])]
    sinks.write_ctab(tx.withColumn("fpkm", F.lit(0.0)), str(tmp_path / "ctab"))
    assert spark.read.csv(str(tmp_path / "ctab/e_data"), sep="\t", header=True).count() == 3
    assert rows(sinks.intron_rows(tx)) == [("c", "+", 21, 29, 1)]
    sinks.write_events(spark.createDataFrame([("a", 1), ("b", 2)], "step string, n long"), str(tmp_path / "ev"), step="a")
    assert rows(spark.read.json(str(tmp_path / "ev")).select("step", "n")) == [("a", 1)]


def test_small_text_formats(spark, tmp_path):
    (tmp_path / "t").write_text("q1\tX1\tg|r1\t=\tz\nq2\tX1\t-\tu\tz\n")
    assert rows(text.read_tracking(spark, str(tmp_path / "t"))) == [("q1", "X1", "g", "r1", "="), ("q2", "X1", None, None, "u")]
    (tmp_path / "b").write_text(">bundle c:5-9 x\nother\n")
    assert rows(text.read_bundle_log(spark, str(tmp_path / "b"))) == [("c", 5, 9)]
    assert text.parse_chain("1-5, 7-9") == [(1, 5), (7, 9)]
    for bad in ("", "5-1", "a-b", "5"):
        with pytest.raises(ValueError):
            text.parse_chain(bad)
    (tmp_path / "l").write_text("b\n# c\na # x\nb\n\n")
    assert text.path_list(str(tmp_path / "l")) == ["a", "b"]
    seg = spark.createDataFrame([("k", 10, 20), ("k", 0, 5)], "k string, start long, end long")
    assert rows(sinks.segment_signature(seg, ["k"])) == [("k", "1-5+11-20")]


def stream(spark, tmp_path, df, name, build):
    src = str(tmp_path / name)
    for i, part in enumerate(df.randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_sessions(spark, tmp_path):
    rng = random.Random(3)
    data = [("c", p := rng.randint(0, 20_000), p + rng.randint(1, 300)) for _ in range(60)] + [("zz", 9_000_000, 9_000_001)]
    df = spark.createDataFrame(data, "chrom string, start long, end long")
    want = rows(ranges.region_table(df.where("chrom = 'c'")))
    assert rows(ST.growing_regions(df).where("chrom = 'c'")) == want
    got = stream(spark, tmp_path, df, "grow", lambda s: ST.growing_regions(s, late_bases=1_000_000))
    assert [r for r in rows(got) if r[0] == "c"] == want
    dup = df.unionByName(df)
    once = stream(spark, tmp_path, dup, "once", lambda s: ST.first_seen(s, ["chrom", "start", "end"], late_bases=10_000_000))
    assert rows(once) == rows(df.distinct()) == rows(ST.first_seen(dup, ["chrom", "start", "end"]))
    o = spark.createDataFrame([("c", 1, 5), ("c", 2, 3), ("c", 3, 9)], "chrom string, i long, start long")
    assert rows(ST.check_order(o, ["chrom"], "start", "i")) == [("c", 1)]
