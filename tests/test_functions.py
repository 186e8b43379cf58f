"""Regions, constructors, sequences, files."""

import pytest
from pyspark.sql import functions as F

from axisweave.config import interval_cols, update_default_colnames
from axisweave.functions import construct, genome, regions
from axisweave.operators.ranges import select
from axisweave.sources import bed, readers
from axisweave.sources.assembly import centromeres, fetch_chromsizes
from axisweave.streaming.joins import stream_overlap


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_regions():
    assert regions.parse_region_string("chr1:1,000-2.5kb") == ("chr1", 1000, 2500)
    assert regions.parse_region("chrX") == ("chrX", 0, None)
    assert regions.parse_region("chrX", {"chrX": 9}) == ("chrX", 0, 9)
    assert regions.parse_region_string("c:5-") == ("c", 5, None)
    for bad in ("c:5", "c:9-2", ":1-2", "c:a-b", "c::1-2"):
        with pytest.raises(ValueError):
            regions.parse_region_string(bad)
    with pytest.raises(ValueError):
        regions.parse_region("c:1-20", {"c": 9})
    assert regions.is_complete_ucsc_string("c:1-2") and not regions.is_complete_ucsc_string("c:1-") and not regions.is_complete_ucsc_string(3)


def test_region_columns(spark):
    df = spark.createDataFrame([("chr1:1k-2kb",), ("chr2",), ("c:7-",)], "r string")
    assert rows(df.select(*regions.region_columns(F.col("r")))) == sorted([("chr1", 1000, 2000), ("chr2", None, None), ("c", 7, None)], key=str)


def test_names():
    with update_default_colnames({"chrom": "chr"}):
        assert interval_cols() == ("chr", "start", "end")
    assert interval_cols().chrom == "chrom"


def test_construct(spark):
    assert rows(construct.from_any(spark, {"a": 5})) == [("a", 0, 5)]
    assert rows(construct.from_any(spark, ["a:1-2", "b"], fill_null={"b": 7})) == [("a", 1, 2), ("b", 0, 7)]
    assert rows(construct.make_viewframe(spark, {"a": 5}, name_style="UCSC")) == [("a", 0, 5, "a:0-5")]
    with pytest.raises(ValueError):
        construct.make_viewframe(spark, [("a", 0, 5), ("a", 3, 9)])
    dirty = spark.createDataFrame([("a", "7", "2"), ("b", "x", "3")], "chrom string, start string, end string")
    assert rows(construct.sanitize_bedframe(dirty, start_exceed_end_action="flip")) == sorted([("a", 2, 7), (None, None, None)], key=str)


def test_sequences(spark):
    seq = spark.createDataFrame([("s1", "AtGcN"), ("s2", "NGATCNN")], "chrom string, seq string")
    df = spark.createDataFrame([("s1", 0, 5), ("s2", 0, 1), ("s2", 5, 5)], "chrom string, start long, end long")
    assert rows(genome.frac_gc(df, seq).select("start", "GC")) == sorted([(0, 0.5), (0, None), (5, None)], key=str)
    assert rows(genome.frac_mapped(df, seq).select("start", "frac_mapped")) == sorted([(0, 0.8), (0, 0.0), (5, 0.0)], key=str)
    assert rows(genome.digest(seq, "DpnII")) == [("s1", 0, 5), ("s2", 0, 3), ("s2", 3, 7)]
    with pytest.raises(ValueError):
        genome.digest(seq, "none")
    sizes = spark.createDataFrame([("a", 10), ("b", 3)], "name string, length long")
    assert rows(genome.binnify(sizes, 4, rel_ids=True)) == [("a", 0, 4, 0), ("a", 4, 8, 1), ("a", 8, 10, 2), ("b", 0, 3, 0)]
    arms = genome.make_chromarms(spark, {"a": 10, "b": 5}, {"a": 4})
    assert rows(arms) == [("a", 0, 4, "a_p"), ("a", 4, 10, "a_q"), ("b", 0, 5, "b_p")]
    assert genome.to_ucsc_colorstring("red") == "255,0,0" and genome.to_ucsc_colorstring(None) == "0"


def test_files(spark, tmp_path):
    p = tmp_path / "x.bed"
    p.write_text("chr2\t1\t5\tn\t7\t+\nchr10\t2\t6\tm\t8\t-\n")
    df = readers.read_table(spark, str(p), "bed6")
    assert df.schema["start"].dataType.simpleString() == "bigint" and df.count() == 2
    assert select(df, "chr2:0-3").count() == 1
    with pytest.raises(ValueError):
        readers.read_table(spark, str(p), "none")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(p), "bed9", schema_is_strict=True)
    s = tmp_path / "sizes"
    s.write_text("chr10\t7\nchr2\t5\nchrX\t3\nscaffold\t1\n")
    assert [r[0] for r in readers.read_chromsizes(spark, str(s)).collect()] == ["chr2", "chr10", "chrX"]
    f = tmp_path / "x.fa"
    f.write_text(">a one\nAC\nGT\n>b\nTT\n")
    assert rows(readers.load_fasta(spark, str(f))) == [("a", "ACGT"), ("b", "TT")]
    sam = tmp_path / "x.sam"
    sam.write_text("@SQ\tSN:ref\tLN:45\nr1\t163\tref\t7\t30\t8M\t=\t37\t39\tTTAG\t*\tNM:i:1\nr2\t0\tref\t9\t0\t4M\t*\t0\t0\tAAAA\t*\n")
    got = readers.read_alignments(spark, str(sam)).orderBy("QNAME").collect()
    assert got[0]["POS"] == 6 and got[0]["TAGs"] == '{"NM":"1"}' and got[1]["CIGAR"] is None
    with pytest.raises(ValueError):
        readers.read_alignments(spark, "x.cram")
    text = bed.to_bed(df.select("chrom", "start", "end"), schema="bed6")
    assert text.splitlines()[0] == "chr2\t1\t5\t.\t0\t."
    bed.to_bed(df, str(tmp_path / "out"), schema="bed6")
    assert rows(readers.read_table(spark, str(tmp_path / "out"), "bed6")) == rows(df)
    with pytest.raises(ValueError):
        bed.to_bed(df.withColumn("strand", F.lit("x")))
    with pytest.raises(TypeError):
        bed.to_bed(df.withColumn("start", F.col("start").cast("double")))


def _block_file(path, magic, blocks, chroms, fields=0, auto=b""):
    """A bigWig or bigBed file by hand: one list of chromosomes, compressed blocks, and an index of one leaf."""
    import struct
    import zlib

    key = max(map(len, chroms))
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 256, key, 8, len(chroms), 0) + struct.pack("<BBH", 1, 0, len(chroms))
    tree += b"".join(struct.pack(f"<{key}sII", n.encode(), k, size) for k, (n, size) in enumerate(chroms.items()))
    head = 64 + len(auto)
    data, leaves = b"", b""
    for (chrom, lo, hi), raw in blocks:
        packed = zlib.compress(raw)
        leaves += struct.pack("<IIIIQQ", chrom, lo, chrom, hi, head + len(tree) + len(data), len(packed))
        data += packed
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, len(blocks), 0, 0, len(chroms), 1000, 0, 1, 0) + struct.pack("<BBH", 1, 0, len(blocks)) + leaves
    top = struct.pack("<IHHQQQHHQQIQ", magic, 4, 0, head, head + len(tree), head + len(tree) + len(data), fields, fields, 64 if auto else 0, 0, 1 << 16, 0)
    path.write_bytes(top.ljust(64, b"\0") + auto + tree + data + index)


def test_big_files(spark, tmp_path):
    import struct

    from axisweave.sources import binary

    chroms = {"chr1": 500, "chr2": 300}
    graph = struct.pack("<IIIIIBBH", 0, 0, 20, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 0, 5, 1.5, 10, 20, 2.0)
    steps = struct.pack("<IIIIIBBH", 1, 100, 130, 10, 5, 3, 0, 3) + struct.pack("<fff", 1, 2, 3)
    places = struct.pack("<IIIIIBBH", 0, 30, 60, 0, 4, 2, 0, 2) + struct.pack("<IfIf", 30, 0.5, 50, 0.25)
    f = tmp_path / "x.bw"
    _block_file(f, binary.BIGWIG, [((0, 0, 20), graph), ((0, 30, 60), places), ((1, 100, 130), steps)], chroms)
    want = [("chr1", 0, 5, 1.5), ("chr1", 10, 20, 2.0), ("chr1", 30, 34, 0.5), ("chr1", 50, 54, 0.25), ("chr2", 100, 105, 1.0), ("chr2", 110, 115, 2.0), ("chr2", 120, 125, 3.0)]
    assert sorted(rows(binary.read_bigwig(spark, str(f)))) == want
    assert sorted(rows(binary.read_bigwig(spark, str(f), "chr1", 12, 40))) == want[1:3]
    with pytest.raises(ValueError):
        binary.read_bigwig(spark, str(f), "chrX")
    with pytest.raises(ValueError):
        binary.read_bigbed(spark, str(f))
    b = tmp_path / "x.bb"
    entries = struct.pack("<III", 0, 3, 9) + b"a\t7\0" + struct.pack("<III", 0, 20, 25) + b"b\t8\0"
    auto = b'table x "y"\n(\nstring chrom; "c"\nuint chromStart; "s"\nuint chromEnd; "e"\nstring label; "l"\nuint score; "n"\n)\0'
    _block_file(b, binary.BIGBED, [((0, 3, 25), entries)], chroms, 5, auto)
    df = binary.read_bigbed(spark, str(b))
    assert df.columns == ["chrom", "start", "end", "label", "score"] and sorted(rows(df)) == [("chr1", 3, 9, "a", "7"), ("chr1", 20, 25, "b", "8")]
    assert rows(binary.read_bigbed(spark, str(b), "chr1", 10)) == [("chr1", 20, 25, "b", "8")]


def test_bam(spark, tmp_path):
    import gzip
    import struct

    def record(name, flag, ref, pos, mapq, cigar, seq, qual, tags):
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
        code = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        packed = bytes(code[i] << 4 | code[i + 1] for i in range(0, len(seq), 2))
        raw = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + qual + tags
        return struct.pack("<i", len(raw)) + raw

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"ref\0" + struct.pack("<i", 45)
    tags = b"NMC\x02" + b"XSZhi\0" + b"XBBs" + struct.pack("<Ihh", 2, -1, 5)
    body = record("r1", 0, 0, 6, 30, [(3, "M"), (2, "S")], "ACGTN", bytes([0, 1, 2, 3, 4]), tags) + record("r2", 4, -1, -1, 0, [], "", b"", b"")
    f = tmp_path / "x.bam"
    f.write_bytes(gzip.compress(head) + gzip.compress(body[:40]) + gzip.compress(body[40:]) + gzip.compress(b""))
    got = {r["QNAME"]: tuple(r)[1:] for r in readers.read_alignments(spark, str(f)).collect()}
    assert got["r1"] == (0, "ref", 6, 30, "3M2S", "*", -1, 0, "ACGTN", "!\"#$%", '{"NM":"2","XS":"hi","XB":"s,-1,5"}')
    assert got["r2"] == (4, "*", -1, 0, None, "*", -1, 0, "*", "*", "{}")
    assert [r["QNAME"] for r in readers.read_alignments(spark, str(f), "ref", 5, 8).collect()] == ["r1"]


def test_indexed_table(spark, tmp_path):
    """Three blocks, an index by hand that names the range's blocks, and the same rows as a scan gives."""
    import gzip
    import struct

    rows_ = [[("chr1", 10, 20), ("chr1", 16_000, 17_000)], [("chr1", 40_000, 40_010), ("chr1", 50_000, 60_000)], [("chr2", 5, 9)]]
    blocks = [gzip.compress("".join("\t".join(map(str, r)) + "\n" for r in b).encode()) for b in rows_]
    begin = [0, len(blocks[0]), len(blocks[0]) + len(blocks[1])]
    end = begin[2] + len(blocks[2])
    f = tmp_path / "x.bed.gz"
    f.write_bytes(b"".join(blocks))
    bare = tmp_path / "y.bed.gz"
    bare.write_bytes(f.read_bytes())
    line = len("chr1\t40000\t40010\n")
    bins = {4681: [(0, 11)], 585: [(11, begin[1] << 16)], 4681 + 2: [(begin[1] << 16, begin[1] << 16 | line)], 4681 + 3: [(begin[1] << 16 | line, begin[2] << 16)]}
    one = struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *c) for c in v) for k, v in bins.items())
    one += struct.pack("<i4Q", 4, 0, 11, begin[1] << 16, begin[1] << 16 | line)
    two = struct.pack("<iIiQQ", 1, 4681, 1, begin[2] << 16, end << 16) + struct.pack("<iQ", 1, begin[2] << 16)
    names = b"chr1\0chr2\0"
    (tmp_path / "x.bed.gz.tbi").write_bytes(gzip.compress(b"TBI\1" + struct.pack("<8i", 2, 0x10000, 1, 2, 3, ord("#"), 0, len(names)) + names + one + two))
    for region in (("chr1", 16_500, 45_000), ("chr1", 0, 15), ("chr1", 45_000, None), ("chr2", None, None), ("chr1", 200_000, 300_000), ("chr3", 0, 5)):
        assert rows(readers.read_tabix(spark, str(f), *region)) == rows(readers.read_tabix(spark, str(bare), *region)), region
    assert rows(readers.read_tabix(spark, str(f), "chr1", 16_500, 45_000)) == [("chr1", 16_000, 17_000), ("chr1", 40_000, 40_010)]


def test_browser_tables(spark, tmp_path):
    import gzip

    from axisweave.sources.remote import BrowserTables

    base = tmp_path / "goldenPath" / "xx1"
    (base / "bigZips").mkdir(parents=True)
    (base / "database").mkdir()
    (base / "bigZips" / "xx1.chrom.sizes").write_text("chr10\t7\nchr2\t5\n")
    for name, text in (("gap", "1\tchr2\t0\t4\t1\tN\t4\ttelomere\tno\n"), ("cytoBand", "chr2\t0\t2\tp1\tacen\nchr2\t2\t5\tq1\tacen\n"), ("centromeres", "1\tchr2\t1\t2\ta\n1\tchr2\t2\t4\tb\n")):
        (base / "database" / f"{name}.txt.gz").write_bytes(gzip.compress(text.encode()))
    t = BrowserTables(spark, "xx1", f"file://{tmp_path}")
    assert [tuple(r) for r in t.fetch_chromsizes().collect()] == [("chr2", 5), ("chr10", 7)]
    assert rows(t.fetch_gaps()) == [("chr2", 0, 4, 4, "telomere", "no")]
    assert rows(centromeres(t.fetch_cytoband())) == [("chr2", 0, 5, 2)]
    assert rows(t.origins()) == [("chr2", 1, 4, 2)]


def test_region_bounds():
    from axisweave.functions.regions import parse_region

    for bad in (("chr1",), ("chr1", 5), ("chr1", -1, 5), ("chr1", 6, 5)):
        with pytest.raises(ValueError):
            parse_region(bad)
    assert parse_region(("chr1", -1, 5), check_bounds=False) == ("chr1", -1, 5) and parse_region(("chr1", None, None, "x")) == ("chr1", 0, None)


def test_bed12_and_gtf(spark):
    row = ("chr1", 100, 200, "n", 5, "+", 100, 200, "255,0,0", 2, "10,20,", "0,80,")
    df = spark.createDataFrame([row], "chrom string, start long, end long, name string, score int, strand string, thickStart long, thickEnd long, itemRgb string, blockCount int, blockSizes string, blockStarts string")
    assert all(bed.validate_bed_fields(df, 12).values())
    bad = bed.validate_bed_fields(df.withColumn("blockStarts", F.lit("0,70,")), 12)
    assert not bad["block_last_at_end"]
    g = spark.createDataFrame([('gene_id "A"; name "b c";',)], "a string").select(readers.parse_gtf_attributes(F.col("a"), " ").alias("m")).first()[0]
    assert g == {"gene_id": "A", "name": "b c"}


def test_assembly(spark):
    assert fetch_chromsizes(spark, "hg38").where("name = 'chr1'").first()["length"] == 248956422
    bands = spark.createDataFrame([("a", 0, 5, "gneg"), ("a", 5, 8, "acen"), ("a", 8, 9, "acen")], "chrom string, start long, end long, stain string")
    assert rows(centromeres(bands)) == [("a", 5, 9, 8)]


def test_stream(spark, tmp_path):
    one = spark.createDataFrame([("c", 0, 5), ("c", 100, 200)], "chrom string, start long, end long")
    one.write.parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([("c", 4, 150)], "chrom string, start long, end long")
    s = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    q = stream_overlap(s, static, width=64).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hits").count() == 2
