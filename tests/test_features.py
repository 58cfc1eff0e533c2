import pytest
from pyspark.sql import functions as F

from alertloom.functions import features, network
from alertloom.functions.features import header_roles
from alertloom.operators.filters import inspectable
from alertloom.sources.flows import LABEL_NAMES, PORT_NAMES, read_flow_csv
from alertloom.sources.packets import PACKETS


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("v"))).collect()]


def test_ports(spark):
    cases = {
        "80": 80, "80.7": 80, "0x50": 0, "-": 0, " 80 ": 80, "1e3": 1000, "": 0, None: 0, "80d": 0, "+7": 7, ".5": 0, "-5": -5,
        "inf": 0, "1e400": 0, "9e300": 0, "5.": 5, "1_0": 0, "\t9\n": 9, "nan": 0,
    }
    assert column(spark, list(cases), "string", features.coerce_port) == list(cases.values())


def test_labels(spark):
    values = ["BENIGN", " Normal ", "0", "DDoS", "1", "1.0", "10", None]
    assert column(spark, values, "string", features.binarise_label) == [0, 0, 0, 1, 1, 0, 0, 1]
    assert column(spark, values, "string", lambda c: features.binarise_label(c, "exact")) == [0, 0, 0, 1, 1, 1, 1, 1]
    with pytest.raises(ValueError):
        features.binarise_label(F.lit("x"), "other")


def test_counts(spark):
    text = "${jndi:ldap://x/a} description SELECT attackattack '"
    assert column(spark, [text], "string", features.special_char_count) == [7]
    assert column(spark, [text], "string", features.keyword_count) == [6]
    assert column(spark, ["é😀"], "string", features.message_length) == [2]


def test_header_roles():
    roles = lambda header: header_roles(header, {"port": PORT_NAMES, "label": LABEL_NAMES})
    assert roles(["Flow", "Dst Port", "Label"]) == ({"port": 1, "label": 2}, None)
    assert roles([" dst_port", "DSTPORT", "attack_cat", "Label"]) == ({"port": 1, "label": 3}, None)
    assert roles(["a", "class"]) == ({"label": 1}, "no column for port")
    assert roles([]) == ({}, "no column for label, port")


def test_headed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dst Port, Label,x\n80,BENIGN,1\n,DDoS,2\n")
    (tmp_path / "b.csv").write_bytes("label,é,Destination_Port\nBot,q,443\n".encode("latin1"))
    (tmp_path / "c.csv").write_text("nothing,here\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "d.txt").write_text("Dst Port,Label\n1,x\n")
    got = read_flow_csv(spark, str(tmp_path), "set").select("dest_port", "raw_label").collect()
    assert sorted(map(tuple, got), key=str) == [("443", "Bot"), ("80", "BENIGN"), (None, "DDoS")]
    assert read_flow_csv(spark, str(tmp_path / "none"), "set").count() == 0


def test_cidr(spark):
    values = ["192.168.1.44", "192.168.2.1", "192.168.1.256", "192.168.01.4", "x", None, "192.168.10.4", "fe80::1"]
    inside = column(spark, values, "string", lambda c: network.in_cidr(c, "192.168.1.0/24"))
    assert inside == [True] + [False] * 7
    odd = ["10.0.0.63", "10.0.0.64", "10.0.0.127", "10.0.0.128"]
    assert column(spark, odd, "string", lambda c: network.in_cidr(c, "10.0.0.64/26")) == [False, True, True, False]
    assert column(spark, ["1.2.3.4", "1.2.3.5"], "string", lambda c: network.in_cidr(c, "1.2.3.4/32")) == [True, False]


def packet(k, payload, src="8.8.8.8", port=80, proto="tcp"):
    return (k, None, proto, src, 1, "192.168.1.44", port, payload, None, None, None, None, None)


def test_packet_filter(spark):
    rows = [
        packet(0, b"1234"), packet(1, b"12345"), packet(2, b"\xff12345"), packet(3, "éabcde".encode()), packet(4, b"a\x0bbcde"),
        packet(5, b"hello", src="192.168.1.44"), packet(6, b"hello", src="192.168.1.45"), packet(7, b"hello", src="192.168.2.1"),
        packet(8, b"hello", port=22), packet(9, b"hello", port=514), packet(10, b"hello", proto="icmp"), packet(11, None),
        packet(12, b"he\x00llo"), packet(13, b"hello\n"),
    ]
    kept = inspectable(spark.createDataFrame(rows, PACKETS))
    assert sorted(r["packet_id"] for r in kept.collect()) == [1, 4, 5, 7, 13]


def test_bad_flow_files_cost_themselves(spark, tmp_path, caplog):
    """Empty, spoilt, undecodable and unusable files are listed with a reason; the others are read."""
    from alertloom.sources.flows import read_flow_csv, survey_flow_files

    good = spark.createDataFrame([(str(k), "BENIGN") for k in range(5000)], "`Dst Port` string, Label string")
    for name, rows in (("good", good), ("spoilt", good), ("ends", good.limit(3))):
        rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "w" / name))
        (part,) = (tmp_path / "w" / name).glob("*.csv")
        crc = part.with_name(f".{part.name}.crc")
        part.rename(tmp_path / f"{name}.csv")
        crc.rename(tmp_path / f".{name}.csv.crc")
    raw = bytearray((tmp_path / "spoilt.csv").read_bytes())
    raw[10:14] = b"XXXX"
    (tmp_path / "spoilt.csv").write_bytes(raw)
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "blank.csv").write_bytes(b"\n1,2\n")
    (tmp_path / "wide.csv").write_bytes("Dst Port,Label\n80,BENIGN\n".encode("utf-16"))
    (tmp_path / "windows.csv").write_bytes(b"dsport,Label\r\n80,DDoS\r\n")
    (tmp_path / "other.csv").write_bytes(b"a,b\n1,2\n")
    report = {r.file.rsplit("/", 1)[1]: (r.rows, r.reason) for r in survey_flow_files(spark, str(tmp_path))[1].collect()}
    assert report["good.csv"] == (5000, None) and report["ends.csv"] == (3, None) and report["windows.csv"] == (1, None)
    assert report["empty.csv"][1] == "empty or unreadable" and report["spoilt.csv"][1] in ("empty or unreadable", "not readable to its end") and report["blank.csv"][1] == "no header"
    assert "no column" in report["other.csv"][1] and report["wide.csv"][1] and len(report) == 8
    assert read_flow_csv(spark, str(tmp_path), "x").count() == 5004
