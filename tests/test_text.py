"""Column functions over catalog text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skuscope.functions import text as t


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_slugs_and_aliases(spark):
    for raw, want in (("Brake Pads", "brake_pads"), ("  Cabin/AC Filter  ", "cabin_ac_filter")):
        assert one(spark, t.category_slug(F.col("a")), a=raw) == want
    for raw, want in (("brake_pad", "Brake Pads"), ("Brake Pad", "Brake Pads"), ("Timing Belt", "Timing Belt")):
        assert one(spark, t.resolve_category(F.col("a")), a=raw) == want
    assert one(spark, t.backend_for_category(F.col("a")), a=" air filter ") == "openclip"
    assert one(spark, t.no_match_threshold(F.col("a")), a="OpenCLIP") == 0.86
    assert one(spark, t.no_match_threshold(F.lit(None).cast("string"))) == 0.48


def test_cells(spark):
    cell = "Toyota RAV4 (2019-2021) | Mini (2018) 2.5L||Universal Fitment|Ford F 150 (2020–2019)"
    rows = one(spark, t.parse_vehicles(F.col("a")), a=cell)
    assert [tuple(r) for r in rows] == [("Toyota", "RAV4", 2019), ("Toyota", "RAV4", 2020), ("Toyota", "RAV4", 2021), ("Mini", "Mini", 2018)]
    assert one(spark, t.skipped_vehicles(F.col("a")), a=cell) == ["Universal Fitment"]
    assert one(spark, t.split_list(F.lit(None).cast("string"))) == []
    for cell, want in (('{"a": "b"}', {"a": "b"}), ("[1]", {}), ("{bad", {}), ("", {})):
        assert one(spark, t.parse_attributes(F.col("a")), a=cell) == want


def test_attributes(spark):
    get = lambda text, category: one(spark, t.extract_attributes(F.lit("Hub"), F.col("a"), F.col("c")), a=text, c=category)
    hub = get("An engineered wheel hub without an ABS sensor, 5-lug. Steel, black then silver.", "Wheel Hub Assembly")
    assert hub == {"material": "steel", "abs_sensor": "no", "primary_colour": "black", "lug_count": "5"}
    assert "primary_colour" not in get("Duralast Gold pads, ceramic", "Brake Pads")
    assert get("no rear. Rear ceramic pads", "Brake Pads")["position"] == "rear"
    assert "position" not in get("does not fit the rear", "Brake Pads")


def test_labels(spark):
    assert one(spark, t.format_category(F.col("a")), a="oil_filter XL") == "Oil Filter XL"
    assert one(spark, t.format_attribute_key(F.col("a")), a="lug_count") == "Wheel studs"
    assert one(spark, t.format_attribute_value(F.col("a")), a="semi-metallic") == "Semi-metallic"
    assert one(spark, t.format_gap(F.lit(0.004))) == "<1%"
    assert one(spark, t.format_percent(F.lit(0.125))) == "13%"
    assert one(spark, t.format_search_time(F.lit(1400.0))) == "1.4 s"
    assert one(spark, t.facet_prompt(F.lit("attr:tooth_count")))["prompt"] == "What's the tooth count?"
    assert one(spark, t.parse_choice(F.col("a"), F.lit(3)), a="I pick #2, not 3") == 1
    assert one(spark, t.parse_choice(F.col("a"), F.lit(3)), a="none") is None
    assert one(spark, t.category_claim(F.lit(True), F.lit(0.88))) == "unconfirmed"


WORDS = ["front", "rear", "cast iron", "cast-iron", "stainless steel", "electric motor", "electro-hydraulic", "golden", "gold", "chrome-plated", "Black", "no", "not", "without", "omits", "5-lug", "15-lug", "duralast gold", "abs", "ABSé", "éabs", "wear sensor", "wear_sensor", "throttle cable-operated", "motor.", ".", "long tube header", "Übergroß", "naïve", "x" * 45, "—", "٣-lug", "pair", "set", "\x01", "\n"]


def in_python(text, category):
    """The rules mention by mention, with Python's regular expressions."""
    text = re.sub(t.BRAND_PHRASES, " ", (" " + text).lower())
    negation = re.compile(rf"\b({'|'.join(t.NEGATORS)})\b[^.]{{0,40}}\Z")
    free = lambda p: [not negation.search(text[: m.start()]) for m in re.finditer(p, text)]
    out = {}
    for attribute, cases in t.RULES.items():
        values = [v for only, values in cases if only in (None, category) for v, p in values if any(free(p))]
        out |= {attribute: values[0]} if values else {}
    for attribute, (p, only) in t.PRESENCE.items():
        if only == category and free(p):
            out[attribute] = "yes" if any(free(p)) else "no"
    colours = [(m.start(), c) for c, p in t.COLOURS.items() if (m := re.search(p, text))]
    out |= {"primary_colour": min(colours)[1]} if colours else {}
    lugs = re.search(r"\b(\d)-lug\b", text)
    return out | ({"lug_count": lugs[1]} if lugs and category == "Wheel Hub Assembly" else {})


def test_attributes_of_any_text_are_pythons(spark):
    r = random.Random(6)
    categories = sorted({c for cases in t.RULES.values() for c, _ in cases if c} | {c for _, c in t.PRESENCE.values()})
    rows = [(i, "".join(r.choice(WORDS) + r.choice([" ", " ", "", ", ", "-"]) for _ in range(r.randrange(0, 40))), r.choice(categories)) for i in range(600)]
    rows += [(1000, None, "Brake Pads"), (1001, "", None), (1002, "front " * 20000, None)]
    got = {x.id: x.m for x in spark.createDataFrame(rows, "id long, text string, category string").select("id", t.extract_attributes(F.lit(None).cast("string"), F.col("text"), F.col("category")).alias("m")).collect()}
    for i, text, category in rows:
        assert got[i] == in_python(text or "", category), (text, category)
    assert sum("abs_sensor" in m for m in got.values()) > 5 and sum("lug_count" in m for m in got.values()) > 5


def test_rules_with_odd_patterns(spark):
    rules = {"kind": [(None, [("one", r"(?:ab|b)c"), ("two", r"b|c{1,2}d{0,3}")])]}
    found = t.extract_attributes(F.lit(""), F.col("a"), F.lit("x"), rules=rules, presence={"there": (r"z\|z", None)}, colours={}, negators=("nope",))
    for text, want in (("abc", {"kind": "one"}), ("xbx z|z", {"kind": "two", "there": "yes"}), ("nope abc. cd", {"kind": "two"}), ("nope z|z", {"there": "no"}), ("", {})):
        assert one(spark, found, a=text) == want
    with pytest.raises(ValueError):
        t.mentions(F.col("a"), ["a+"])
