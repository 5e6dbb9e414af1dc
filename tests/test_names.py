"""Canonical names and addresses: the published examples, and columns of them."""

import pytest
from pyspark.sql import functions as F

from mailsonde.functions import names
from mailsonde.operators import detectors

#: Samples of RFC 3492, 7.1.
SAMPLES = {
    "ليهمابتكلموشعربي؟": "egbpdaj6bu4bxfgehfvwxn", "他们为什么不说中文": "ihqwcrb4cv8a8dqg056pqjye",
    "Pročprostěnemluvíčesky": "Proprostnemluvesky-uyb24dma41a", "3年B組金八先生": "3B-ww4c5e180e575a65lsy2b", "MajiでKoiする5秒前": "MajiKoi5-783gue6qz075azm5e", "そのスピードで": "d9juau41awczczp",
}


@pytest.mark.parametrize("text", SAMPLES)
def test_published_samples(text):
    assert text.encode("punycode").decode() == SAMPLES[text]
    if "؟" not in text:  # a question mark is no part of a name
        assert names.canonical_label(text) == ("xn--" + text.lower().encode("punycode").decode())
        assert names.canonical_label(names.canonical_label(text)) == names.canonical_label(text)
    else:
        assert names.canonical_label(text) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Example.ORG.", "example.org"), ("Bücher.example", "xn--bcher-kva.example"), ("XN--BCHER-KVA.example", "xn--bcher-kva.example"), ("ＢＵＲ。example", "bur.example"), ("bücher.example", "xn--bcher-kva.example"),
        ("faß.de", "xn--fa-hia.de"), ("*.example.org", "*.example.org"), ("so­ft.org", "soft.org"), ("a..b", None), ("", None), (None, None), (".", None), ("a b.org", None), ("xn--zz99999999.org", None), ("xn--abc-.org", None), ("x" * 64 + ".org", None),
        ("x" * 63 + ".org", "x" * 63 + ".org"), (".".join(["abcdefg"] * 40), None), ("10.0.0.1", None), ("under_score.org", "under_score.org"), ("☃.org", None),
    ],
)
def test_names(text, want):
    assert names.canonical_name(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2001:db8:0:0:1:0:0:1", "2001:db8::1:0:0:1"), ("2001:0DB8::0001", "2001:db8::1"), ("2001:db8:0:1:1:1:1:1", "2001:db8:0:1:1:1:1:1"), ("0:0:0:0:0:0:0:0", "::"), ("::ffff:192.0.2.1", "::ffff:192.0.2.1"), ("[FE80::1%eth0]", "fe80::1%eth0"),
        (" 192.0.2.1 ", "192.0.2.1"), ("192.0.2.01", None), ("192.0.2", None), ("a:b", None), ("", None), (None, None), ("1::2::3", None),
    ],
)
def test_addresses(text, want):
    assert names.canonical_address(text) == want


def test_columns(spark):
    rows = [("BÜCHER.example", ["xn--bcher-kva.example", None]), ("[2001:DB8::0:1]", []), (None, None), ("no name", ["A.org", "no name"])]
    df = spark.createDataFrame(rows, "h string, s array<string>")
    got = detectors.canonical_references(df, ["h"], ["s"]).collect()
    assert [r["h"] for r in got] == ["xn--bcher-kva.example", "2001:db8::1", None, "no name"]
    assert [r["s"] for r in got] == [["xn--bcher-kva.example", ""], [], None, ["a.org", "no name"]]
    assert [r[0] for r in df.select(names.canonical_names(F.col("h"))).collect()] == ["xn--bcher-kva.example", None, None, None]
    assert [r[0] for r in df.select(names.canonical_addresses(F.col("h"))).collect()] == [None, "2001:db8::1", None, None]
    assert detectors.canonical_references(df.limit(0), ["h"], ["s"]).count() == 0
