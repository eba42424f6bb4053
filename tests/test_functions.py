from pyspark.sql import functions as F

from tracewright.functions import bits, texts, times
from tracewright.functions.detectors import semantic_type, value_class


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_times(spark):
    assert str(one(spark, times.filetime(F.lit(132545159093252998).cast("bigint")))) == "2021-01-07 17:58:29.325299"
    assert one(spark, times.browser_time(F.lit("0"))) == "" and one(spark, times.browser_time(F.lit("1" * 19))) == "1" * 19
    assert str(one(spark, times.unix_by_length(F.lit("1609493672426")))) == "2021-01-01 09:34:32.426000" and one(spark, times.unix_by_length(F.lit("16"))) is None
    assert one(spark, times.duration_text(F.lit(3661))) == "1:01:01" and one(spark, times.duration_text(F.lit(90061))) == "1 day, 1:01:01" and one(spark, times.duration_text(F.lit(-1))) == "-1 day, 23:59:59"
    assert one(spark, times.in_zone(F.lit("2024-01-01T00:00:00Z"), "America/St_Johns")) == "2023-12-31T20:30:00-03:30"
    assert one(spark, times.in_zone(F.lit(""), "Asia/Seoul")) == "" and one(spark, times.in_zone(F.lit("junk"), "Asia/Seoul")) == "0"
    assert one(spark, times.unix_micros_of_filetime(F.lit(11644473601), F.lit(15))) == 1000001
    assert str(one(spark, times.mail_time(F.lit("Tue, 05 Mar 2024 10:11:12 GMT")))) == "2024-03-05 10:11:12"
    assert one(spark, times.after_epoch(F.lit(None).cast("string"))) is False


def test_texts(spark):
    assert one(spark, texts.base_name(F.lit("C:\\a\\b.txt"))) == "b.txt" and one(spark, texts.folder(F.lit("C:\\a\\b.txt"))) == "C:/a" and one(spark, texts.folder(F.lit("b"))) == ""
    assert one(spark, texts.extension(F.lit(".profile"))) == "" and one(spark, texts.extension(F.lit("a.tar.GZ"))) == "GZ"
    assert one(spark, texts.rot13(F.lit("Uryyb"))) == "Hello"
    assert one(spark, texts.guid(F.lit("00112233445566778899aabbccddeeff"))) == "33221100-5544-7766-8899-aabbccddeeff"
    assert one(spark, texts.little_endian(F.lit("0201"))) == 258
    assert one(spark, texts.within(F.lit('<Data Name="TargetUserName">bob</Data>'), "TargetUserName")) == "bob" and one(spark, texts.within(F.lit("x"), "y")) is None
    assert one(spark, texts.search_site(F.lit("https://www.google.com/search"))) == "Google"
    assert one(spark, texts.without_nulls(F.lit(" null "))) is None


def test_bits(spark):
    ref = F.lit((5 << 48) + 77)
    assert one(spark, bits.entry_number(ref)) == 77 and one(spark, bits.sequence_number(ref)) == 5
    assert one(spark, bits.slack_bytes(F.lit(4097), 4096)) == 4095 and one(spark, bits.slack_bytes(F.lit(4096), 4096)) == 0 and one(spark, bits.slack_bytes(F.lit(1), 0)) == 0
    assert one(spark, bits.unsigned_high(F.lit(-1).cast("bigint"))) == 0xFFFFFFFF
    assert tuple(one(spark, bits.transition(F.lit(0x30000001).cast("bigint")))) == ("typed", "chain_start|chain_end")


def test_detectors(spark):
    cases = [("1609493672426", "date", ("TIMESTAMP", "unixtime_millisec")), ("13254945272426000", "t", ("TIMESTAMP", "chrome_time")), ("a.b@example.org", "x", ("ACCOUNT", "email")), ("010-1234-5678", "x", ("PHONE", "phonenumber")), ("1234567", "x", ("UNKNOWN", "UNKNOWN")), ("192.168.0.1", "x", ("IP", "ipv4")), ("00:11:22:aa:bb:cc", "x", ("MAC", "mac")), ("https://a.test/b", "x", ("URL", "url")), ("127.0512", "x", ("GEODATA", "longitude")), ("37.5123", "x", ("GEODATA", "latitude")), ("122.9999", "x", ("UNKNOWN", "UNKNOWN")), ("/data/x/y", "x", ("FILE", "path")), ("1609493672", "user_id", ("UNKNOWN", "UNKNOWN")), ("com.example.app", "x", ("PACKAGE", "package")), (None, "x", ("UNKNOWN", "UNKNOWN")), ("yes", "x", ("UNKNOWN", "UNKNOWN"))]
    frame = spark.createDataFrame([(v, c) for v, c, _ in cases], "v string, c string")
    got = [tuple(r["t"]) for r in frame.select(semantic_type(F.col("v"), F.col("c")).alias("t")).collect()]
    assert got == [w for *_, w in cases]
    assert [one(spark, value_class(F.lit(v))) for v in ("12", "1.5", "-3", "한글", "a1", "a b", " ")] == ["int", "float", "negative", "alpha", "alnum", "text", "unknown"]
