"""Column functions over catalog text: slugs, cells, labels, attribute rules."""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the catalog format and its display.
CATEGORY_ALIASES = {
    "air_filter": "Air Filter", "brake_pad": "Brake Pads", "brake_pads": "Brake Pads", "exhaust_manifold": "Exhaust Manifold", "fuel_injector": "Fuel Injector", "oil_filter": "Oil Filter",
    "power_steering_pump": "Power Steering Pump", "shock_absorber": "Shock Absorber", "suspension_bushing": "Suspension Bushing", "throttle_body": "Throttle Body", "wheel_hub_assembly": "Wheel Hub Assembly",
}
BACKEND_DEFAULT = "dinov2"
BACKEND_BY_CATEGORY = {"Air Filter": "openclip", "Wheel Hub Assembly": "openclip", "Shock Absorber": "openclip"}
NO_MATCH_THRESHOLDS = {"openclip": 0.86, "dinov2": 0.48}
NO_MATCH_DEFAULT = 0.48
UNCERTAIN_BELOW, UNCERTAIN_MARGIN, CATEGORY_TRUST = 0.5, 0.04, 0.75
KEY_LABELS = {"primary_colour": "Colour", "sold_as": "Sold as", "abs_sensor": "ABS sensor", "lug_count": "Wheel studs", "mpn": "Part number"}
VALUE_LABELS = {
    "strut-assembly": "Strut assembly", "shock-absorber": "Shock absorber", "remote-reservoir": "Remote reservoir", "air-strut": "Air strut", "long-tube-header": "Long-tube header", "shorty-header": "Shorty header", "oem-manifold": "OEM manifold",
    "direct-injection": "Direct injection", "common-rail": "Common rail", "dual-fuel": "Dual fuel", "unit-injector": "Unit injector", "stainless-steel": "Stainless steel", "cast-iron": "Cast iron", "yes": "Yes", "no": "No",
}
PROMPTS = {
    "make": ("Which vehicle is this part for?", "These candidates fit different makes."),
    "model": ("Which model?", "Narrowing further by model."),
    "year": ("Which model year?", "The remaining candidates cover different year ranges."),
    "mpn": ("Is one of these numbers on the part?", "Usually stamped into the metal or printed on the old box."),
    "brand": ("Do you know the part brand?", "Often stamped on the part or printed on the old packaging."),
    "attr:primary_colour": ("What colour is it, mainly?", "The body, not the fittings."),
    "attr:filter_style": ("Is it a spin-on canister or a cartridge insert?", "Look at the shape."),
    "attr:filter_shape": ("What shape is the filter?", ""),
    "attr:position": ("Where does it fit on the vehicle?", "Front or rear axle."),
    "attr:material": ("What is it made of?", ""),
    "attr:friction_material": ("What is the friction material?", "Usually printed on the pad edge or box."),
    "attr:injector_type": ("Which type of injector is it?", ""),
    "attr:pump_style": ("Which type of pump is it?", ""),
    "attr:throttle_control": ("Is it cable-operated or electronic?", "Look for a cable pulley or a plug."),
    "attr:sold_as": ("How many are in the set?", ""),
    "attr:lug_count": ("How many wheel studs does it have?", "Count the bolts on the flange."),
    "attr:abs_sensor": ("Does it have an ABS sensor?", "A wire running off the hub."),
    "attr:wear_sensor": ("Does it have a wear sensor?", "A small wire clipped to one pad."),
    "attr:pulley_fitted": ("Is the pulley already fitted?", ""),
    "attr:integrated_reservoir": ("Does it have a fluid reservoir on top?", ""),
    "attr:catalytic_converter": ("Does it include a catalytic converter?", ""),
}
NEGATORS = ("no", "not", "without", "lacks", "lacking", "absent", "omits")
BRAND_PHRASES = r"duralast gold|duralast elite"
#: attribute -> [(category or None, [(value, pattern)])], the first value that matches.
RULES = {
    "position": [(None, [("front", r"\bfront\b"), ("rear", r"\brear\b")])],
    "sold_as": [(None, [("pair", r"\bpair\b"), ("set", r"\bset\b"), ("single", r"\bsingle\b")])],
    "material": [(None, [("polyurethane", r"\bpolyurethane\b"), ("cast-iron", r"\bcast[- ]iron\b"), ("stainless-steel", r"\bstainless\b"), ("aluminium", r"\baluminium\b|\baluminum\b"), ("rubber", r"\brubber\b"), ("steel", r"\bsteel\b")])],
    "filter_style": [("Oil Filter", [("spin-on", r"\bspin-on\b"), ("cartridge", r"\bcartridge\b")])],
    "filter_shape": [("Air Filter", [("cabin", r"\bcabin\b"), ("conical", r"\bcone\b|\bconical\b"), ("panel", r"\bpanel\b|\brectangular\b"), ("round", r"\bround\b"), ("oval", r"\boval\b")])],
    "friction_material": [("Brake Pads", [("ceramic", r"\bceramic\b"), ("semi-metallic", r"\bsemi-metallic\b"), ("organic", r"\borganic\b")])],
    "manifold_style": [("Exhaust Manifold", [("long-tube-header", r"\blong[- ]tube\b"), ("shorty-header", r"\bshorty\b"), ("header", r"\bheader\b"), ("oem-manifold", r"\bmanifold\b")])],
    "injector_type": [("Fuel Injector", [("common-rail", r"\bcommon[- ]rail\b"), ("direct-injection", r"\bdirect injection\b|\bgdi\b"), ("dual-fuel", r"\blpg\b|\bcng\b|\bdual-fuel\b"), ("unit-injector", r"\bunit injector\b|\buis\b"), ("port", r"\bport\b")])],
    "pump_style": [("Power Steering Pump", [("electro-hydraulic", r"\belectro-hydraulic\b|\belectric motor\b"), ("hydraulic", r"\bhydraulic\b")])],
    "damper_style": [("Shock Absorber", [("air-strut", r"\bair[- ]ride\b|\bair spring\b|\bair suspension\b"), ("remote-reservoir", r"\bremote[- ]reservoir\b|\bpiggyback\b"), ("strut-assembly", r"\bstrut\b"), ("shock-absorber", r"\bshock absorber\b")])],
    "throttle_control": [("Throttle Body", [("cable-operated", r"\bcable[- ]operated\b|\bthrottle cable\b"), ("electronic", r"\belectronic\b|\bdrive[- ]by[- ]wire\b|\bmotor\b")])],
}
#: attribute -> (pattern, category)
PRESENCE = {
    "abs_sensor": (r"\babs\b", "Wheel Hub Assembly"),
    "integrated_reservoir": (r"\breservoir\b", "Power Steering Pump"),
    "catalytic_converter": (r"\bcatalytic converter\b", "Exhaust Manifold"),
    "wear_sensor": (r"\bwear[- ]sensor\b|\bwear indicator\b", "Brake Pads"),
    "pulley_fitted": (r"\bpulley\b", "Power Steering Pump"),
}
COLOURS = {
    "black": r"\bblack\b", "blue": r"\bblue\b", "silver": r"\bsilver\b", "chrome": r"\bchrome(?:-plated)?\b", "red": r"\bred\b", "yellow": r"\byellow\b",
    "tan": r"\btan\b", "grey": r"\bgrey\b|\bgray\b|\bgraphite\b", "green": r"\bgreen\b", "bronze": r"\bbronze\b", "gold": r"\bgold(?:en)?\b",
}
# End of the fixed values.


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def category_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def resolve_category(label: Column, aliases: dict | None = None) -> Column:
    """The catalog's name of a classifier label; unknown labels stay as they are."""
    return F.coalesce(looked_up(aliases or CATEGORY_ALIASES, category_slug(label)), label)


def backend_for_category(c: Column, overrides: dict | None = None, default: str = BACKEND_DEFAULT) -> Column:
    table = {k.strip().lower(): v for k, v in (BACKEND_BY_CATEGORY if overrides is None else overrides).items()}
    return F.coalesce(looked_up(table, F.lower(strip(c))), F.lit(default)) if table else F.lit(default)


def no_match_threshold(backend: Column, thresholds: dict | None = None, default: float = NO_MATCH_DEFAULT) -> Column:
    table = {k.lower(): float(v) for k, v in (NO_MATCH_THRESHOLDS if thresholds is None else thresholds).items()}
    return F.coalesce(looked_up(table, F.lower(backend)), F.lit(float(default))) if table else F.lit(float(default))


def split_list(cell: Column) -> Column:
    """A '|'-separated cell as its trimmed, non-empty parts; null gives none."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda x: x != "")


_RANGE, _ONE = r"^(.*?)\s*\((\d{4})\s*[-–]\s*(\d{4})\)", r"^(.*?)\s*\((\d{4})\)"


def _vehicle_entries(entry: Column) -> Column:
    """One cell entry as {make, model, year} for each of its years."""
    has_range = entry.rlike(_RANGE)
    name = strip(F.when(has_range, F.regexp_extract(entry, _RANGE, 1)).otherwise(F.regexp_extract(entry, _ONE, 1)))
    first = F.when(has_range, F.regexp_extract(entry, _RANGE, 2)).otherwise(F.regexp_extract(entry, _ONE, 2)).try_cast("int")
    last = F.when(has_range, F.regexp_extract(entry, _RANGE, 3)).otherwise(F.regexp_extract(entry, _ONE, 2)).try_cast("int")
    words = F.split(name, r"\s+")
    several = F.size(words) > 1
    make = F.when(several, F.get(words, 0)).otherwise(name)
    model = F.when(several, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(name)
    years = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
    return F.transform(years, lambda y: F.struct(make.alias("make"), model.alias("model"), y.alias("year")))


def parse_vehicles(cell: Column) -> Column:
    """Entries "Name (YYYY-YYYY)" or "Name (YYYY)", a row a year. The first word is
    the make; a single word is both make and model; a range that ends before it
    begins has no year."""
    return F.flatten(F.transform(F.filter(split_list(cell), lambda e: e.rlike(_ONE) | e.rlike(_RANGE)), _vehicle_entries))


def skipped_vehicles(cell: Column) -> Column:
    return F.filter(split_list(cell), lambda e: ~(e.rlike(_ONE) | e.rlike(_RANGE)))


def parse_attributes(cell: Column) -> Column:
    """A JSON object as a map of strings; anything else gives an empty map."""
    return F.coalesce(F.from_json(cell, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def attributes_malformed(cell: Column) -> Column:
    return blank_to_null(cell).isNotNull() & F.from_json(cell, "map<string,string>").isNull()


def attribute_text(name: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.regexp_replace(text, BRAND_PHRASES, " ")


_LUGS = r"\b(\d)-lug\b"


def _longest(pattern: str) -> int:
    """The most characters that a pattern's match can have."""
    width = _parser.parse(pattern).getwidth()[1]
    if width > 1000:
        raise ValueError(f"a pattern with a bounded match is needed: {pattern}")
    return width


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, if those beside each other are all it has."""
    parts, depth = [""], 0
    for c in re.findall(r"\\.|\[[^\]]*\]|.", pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def mentions(text: Column, patterns: list[str], negators=NEGATORS) -> Column:
    """Where any of the patterns matches in a text, in order: an array of negated (one of the negators stands within 40
    characters before, in the same sentence) and window (the character before, the match and the character after at least).

    One scan over the text marks the places; letters of any script are letters.
    """
    alternatives = [x for p in dict.fromkeys(patterns) for x in _alternatives(p)]
    most = max(map(_longest, alternatives), default=0) + 1
    first = [re.match(r"\\b(\w|\\d)", x) for x in alternatives]
    if alternatives and all(first):  # what can't begin a word of theirs is passed by
        found = rf"(?=[{''.join(sorted({m[1] for m in first}))}])\b(?=" + "|".join(x.removeprefix(r"\b") for x in alternatives) + ")"
    else:
        found = "(?=" + "|".join(alternatives or ["(?!)"]) + ")"
    place = rf"(?sU){found}(?=(.{{0,{most}}}))(?<=(.))(?:(?<=\b({'|'.join(map(re.escape, negators))})\b[^.]{{0,40}}))?"
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(text, "[\x01\x02]", " ")), place, "\x01$3\x02$2$1\x01")
    places = F.filter(F.split(marked, "\x01"), lambda x: x.contains("\x02"))
    return F.transform(places, lambda x: F.struct((F.substring_index(x, "\x02", 1) != "").alias("negated"), F.substring_index(x, "\x02", -1).alias("window")))


def _matches(pattern: str):
    """Whether a mention is one of the pattern."""
    return lambda mention: mention["window"].rlike(rf"(?sU)^.(?:{pattern})")


def extract_attributes(name: Column, description: Column, category: Column, *, rules=None, presence=None, colours=None, negators=NEGATORS) -> Column:
    """Attributes of a product from its prose, as a map.

    By rule the first value with a mention that isn't negated; present features
    as yes or no (no if all mentions are negated); the colour mentioned first
    (of equal places the first by name); studs of wheel hubs. The text is
    scanned once for all mentions, and the rules choose from their list.
    """
    rules, presence, colours = (RULES if rules is None else rules), (PRESENCE if presence is None else presence), (COLOURS if colours is None else colours)
    patterns = [p for cases in rules.values() for _, values in cases for _, p in values] + [p for p, _ in presence.values()] + [*colours.values(), _LUGS.replace("(", "").replace(")", "")]
    found = mentions(attribute_text(name, description), patterns, negators)
    none = F.create_map().cast("map<string,string>")
    # The list is made once a row, as the one element of an array that the rules are applied to.
    return F.get(F.transform(F.array(found), lambda m: F.when(F.size(m) == 0, none).otherwise(_attributes_in(m, category, rules, presence, colours))), 0)


def _attributes_in(found: Column, category: Column, rules, presence, colours) -> Column:
    said = F.filter(found, lambda m: ~m["negated"])
    entries: list[tuple[str, Column]] = []
    for attribute, cases in rules.items():
        value = F.lit(None).cast("string")
        for only, values in reversed(cases):
            for label, pattern in reversed(values):
                hit = F.exists(said, _matches(pattern))
                value = F.when(hit if only is None else (category == only) & hit, F.lit(label)).otherwise(value)
        entries.append((attribute, value))
    for attribute, (pattern, only) in presence.items():
        value = F.when(F.exists(said, _matches(pattern)), "yes").when(F.exists(found, _matches(pattern)), "no")
        entries.append((attribute, F.when(category == only, value) if only else value))
    if colours:
        named = F.transform(found, lambda m: F.coalesce(*[F.when(_matches(colours[c])(m), F.lit(c)) for c in sorted(colours)]))
        entries.append(("primary_colour", F.get(F.filter(named, lambda x: x.isNotNull()), 0)))
    lugs = F.filter(F.transform(found, lambda m: F.regexp_extract(m["window"], rf"(?sU)^.{_LUGS}", 1)), lambda x: x != "")
    entries.append(("lug_count", F.when(category == "Wheel Hub Assembly", F.get(lugs, 0))))
    listed = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries])
    return F.map_from_entries(F.filter(listed, lambda e: e["value"].isNotNull()))


def clean_attributes(attributes: Column) -> Column:
    """Without null and blank values."""
    return F.map_filter(attributes, lambda k, v: v.isNotNull() & (strip(v) != ""))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def format_category(raw: Column) -> Column:
    """oil_filter -> Oil Filter; the rest of a word stays as it is."""
    words = F.filter(F.split(F.regexp_replace(raw, r"[_-]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, upper_first), " ")


def format_attribute_key(key: Column) -> Column:
    return F.coalesce(looked_up(KEY_LABELS, key), upper_first(F.trim(F.regexp_replace(key, r"[_-]+", " "))))


def format_attribute_value(value: Column) -> Column:
    return F.coalesce(looked_up(VALUE_LABELS, value), upper_first(value))


def format_percent(value: Column) -> Column:
    """Rounds halves up."""
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def format_gap(value: Column) -> Column:
    return F.when((value * 100 > 0) & (value * 100 < 0.5), "<1%").otherwise(format_percent(value))


def format_search_time(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s")))


def format_years(first: Column, last: Column, dash: str = "–") -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit(dash), last.cast("string")))


def fitment_summary(ranges: Column) -> Column:
    """The first range, and how many more; null for none."""
    first = F.get(ranges, 0)
    label = F.concat(first["make"], F.lit(" "), first["model"], F.lit(" ("), first["year_start"].cast("string"), F.lit("–"), first["year_end"].cast("string"), F.lit(")"))
    more = F.when(F.size(ranges) > 1, F.concat(F.lit(" +"), (F.size(ranges) - 1).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(ranges) > 0, F.concat(label, more))


def facet_prompt(facet: Column) -> Column:
    """prompt and hint of a question; an unknown attribute's name is put in words."""
    known = F.try_element_at(F.create_map(*[x for k, (p, h) in PROMPTS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("prompt"), F.lit(h).alias("hint")))]), facet)
    label = F.lower(format_attribute_key(F.regexp_replace(facet, "^attr:", "")))
    other = F.struct(F.concat(F.lit("What's the "), label, F.lit("?")).alias("prompt"), F.lit("Compare against the part in your photo.").alias("hint"))
    return F.coalesce(known, other)


def parse_choice(reply: Column, n: Column) -> Column:
    """0-based pick out of a reply: the first word whose digits are a number in 1..n; else null."""
    numbers = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"[^0-9]", "").try_cast("int"))
    return F.try_element_at(F.filter(numbers, lambda x: (x >= 1) & (x <= n)), F.lit(1)) - 1


def category_claim(no_match: Column, confidence: Column) -> Column:
    return F.when(~no_match, "stated").when(confidence >= CATEGORY_TRUST, "unconfirmed").otherwise("not recognised")


def displayable_image(paths: Column) -> Column:
    first = F.get(paths, 0)
    return F.when(first.rlike("^https?://"), first)
