"""License scans with ordered signature rules, in DataFrame expressions only.

A text is reduced to its words. The set of words that are some rule's keyword is the
prefilter: only rules whose keyword stands in the text are tried, and texts without any
keyword are not looked at again. A rule is a regular expression over the words joined by
single blanks; it matches whole words. Of overlapping detections the rules' order decides:
a detection that lies inside another of the same or a higher class (0 is the highest),
of the same extent and an earlier rule included, is suppressed. Since an array of
detections sorted by start, then by falling end, has every container before what it
contains, one pass with the largest end so far of each class finds the suppressed ones.

All of it happens inside the row: no shuffle, and a very long text is one long array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOTICE, NAME, HINT = 0, 1, 2
SCORES = {NOTICE: 1.0, NAME: 0.8, HINT: 0.5}

# Places that are counted whatever suppresses them: phrase -> label.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# label, keyword (a word every match holds), pattern of the name over the words of a text.
NAMES = [
    ("mit", "mit", r"mit licen[sc]e"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit-0", "mit", r"mit (?:no attribution|0)(?: licen[sc]e)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v ?)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?(?: licen[sc]e)?"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|two clause|simplified|freebsd) bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"bsd (?:2|two) clause(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|three clause|new|modified|revised) bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|original|old) bsd(?: licen[sc]e)?"),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("gpl-1.0", "gpl", r"gpl (?:version |v ?)?1(?: 0)?"),
    ("gpl-1.0", "gplv1", r"gplv1(?: 0)?"),
    ("gpl-1.0", "gpl1", r"gpl1(?: 0)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[sc]e (?:version |v ?)2(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:version |v ?)?2(?: 0)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl (?:version |v ?)?3(?: 0)?"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl-2.0", "lgpl", r"lgpl (?:version |v ?)?2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v ?)2 1"),
    ("lgpl-2.1", "lgpl", r"lgpl (?:version |v ?)?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("lgpl-3.0", "lgpl", r"lgpl (?:version |v ?)?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("agpl-3.0", "agpl", r"agpl (?:version |v ?)?3(?: 0)?"),
    ("agpl-3.0", "agplv3", r"agplv3"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e(?: (?:version |v ?)1 [123])?"),
    ("gfdl", "gfdl", r"gfdl(?: 1 [123])?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("mpl-2.0", "mpl", r"mpl (?:version |v ?)?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cddl-1.0", "cddl", r"cddl(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("eupl-1.1", "eupl", r"eupl (?:version |v ?)?1 1"),
    ("eupl-1.2", "eupl", r"eupl (?:version |v ?)?1 2"),
    ("eupl", "european", r"european union public licen[sc]e"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?: (?:version |v ?)?2)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: (?:version |v ?)?3 01)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("osl-3.0", "open", r"open software licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("afl-3.0", "academic", r"academic free licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("ofl-1.1", "sil", r"sil open font licen[sc]e(?: (?:version |v ?)?1 1)?"),
    ("odbl-1.0", "odbl", r"odbl(?: (?:version |v ?)?1(?: 0)?)?"),
    ("odbl-1.0", "database", r"open database licen[sc]e"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("pddl", "pddl", r"pddl(?: 1 0)?"),
    ("bsl-1.1", "business", r"business source licen[sc]e(?: (?:version |v ?)?1 1)?"),
    ("sspl-1.0", "side", r"server side public licen[sc]e(?: (?:version |v ?)?1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("openrail", "openrail", r"openrail(?: m)?(?: licen[sc]e)?"),
    ("openrail", "rail", r"(?:open )?rail(?: m)? licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "zero", r"cc zero"),
    ("cc-pdm", "mark", r"public domain mark(?: 1 0)?"),
]

# Words in front of a name, or around it, that make it a notice.
NOTICES = [
    r"(?:is |are |be )?(?:dual |also )?(?:licensed|licenced) (?:to you )?under (?:the )?(?:terms of (?:the )?)?{}",
    r"(?:released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of (?:the )?)?{}",
    r"(?:subject to|governed by|covered by|terms of) (?:the )?(?:terms of (?:the )?)?{}",
    r"(?:spdx )?licen[sc]e(?: identifier)? {}",
]

# Short identifiers that are no name of a license where nothing says so: label, keyword, pattern.
SHORT = [
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("apache-1.1", "apache", r"apache 1 1"),
    ("bsd-4-clause", "bsd", r"bsd (?:4|four) clause"),
    ("bsd", "bsd", r"bsd"),
    ("lgpl-2.0", "lgplv2", r"lgplv2(?: 0)?"),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1"),
    ("lgpl-3.0", "lgplv3", r"lgplv3(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl (?:version |v ?)?1 1"),
    ("mpl", "mpl", r"mpl"),
    ("epl-1.0", "epl", r"epl (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "epl", r"epl (?:version |v ?)?2(?: 0)?"),
    ("epl", "epl", r"epl"),
    ("edl-1.0", "edl", r"edl (?:version |v ?)?1(?: 0)?"),
    ("cpl-1.0", "cpl", r"cpl (?:version |v ?)?1(?: 0)?"),
    ("eupl", "eupl", r"eupl"),
    ("artistic-1.0", "artistic", r"artistic 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic 2(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib"),
    ("libpng", "libpng", r"libpng(?: 2 0)?"),
    ("bsl-1.0", "bsl", r"bsl 1 0"),
    ("psf-2.0", "psf", r"psf 2(?: 0)?"),
    ("php-3.01", "php", r"php 3 01"),
    ("ruby", "ruby", r"ruby"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("ncsa", "ncsa", r"ncsa"),
    ("ms-pl", "pl", r"ms pl"),
    ("ms-rl", "rl", r"ms rl"),
    ("osl-3.0", "osl", r"osl (?:v ?)?3(?: 0)?"),
    ("afl-3.0", "afl", r"afl (?:v ?)?3(?: 0)?"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: (?:version |v ?)?1 1)?"),
    ("bsl-1.1", "bsl", r"bsl 1 1"),
    ("bsl-1.1", "busl", r"busl(?: 1 1)?"),
    ("sspl-1.0", "sspl", r"sspl(?: (?:v ?)?1(?: 0)?)?"),
    ("elastic-2.0", "elastic", r"elastic 2(?: 0)?"),
    ("cc-pdm", "pdm", r"cc pdm(?: 1 0)?"),
]
# What makes them a notice: the notices with "under" and "license (identifier)".
SHORT_NOTICE = "(?:" + "|".join(NOTICES[i].format("") for i in (0, 1, 3)) + ")(?:{})"

CC_RIGHTS = {
    "by": r"(?:by|attribution)",
    "by-sa": r"(?:by sa|attribution share ?alike)",
    "by-nc": r"(?:by nc|attribution non ?commercial)",
    "by-nd": r"(?:by nd|attribution no ?deriv(?:ative)?s?)",
    "by-nc-sa": r"(?:by nc sa|attribution non ?commercial share ?alike)",
    "by-nc-nd": r"(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)",
}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

# label, keyword, class, pattern: whole notices and hints without a license's name.
PHRASES = [
    ("mit", "hereby", NOTICE, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "hereby", NOTICE, r"permission is hereby granted free of charge"),
    ("bsd", "redistribution", NOTICE, r"redistribution and use in source and binary forms"),
    ("isc", "purpose", NOTICE, r"permission to use copy modify and or distribute this software for any purpose"),
    ("apache-2.0", "apache", NOTICE, r"www apache org licenses license 2 0"),
    ("gpl", "gnu", NOTICE, r"www gnu org (?:licenses|copyleft)(?: gpl(?: \d \d)?)?"),
    ("cc", "creativecommons", NOTICE, r"creativecommons org licenses [a-z0-9 ]{2,20} \d \d"),
    ("cc0-1.0", "creativecommons", NOTICE, r"creativecommons org publicdomain zero 1 0"),
    ("cc", "commons", HINT, r"creative commons(?: licen[sc]e)?"),
    ("public-domain", "domain", NAME, r"(?:in|into|to|released to) the public domain"),
    ("public-domain", "domain", HINT, r"public domain"),
    ("copyright", "copyright", HINT, r"copyright(?: c| ©)?(?: \d{4})+"),
    ("copyright", "copyright", HINT, r"copyright"),
    ("reserved", "reserved", NAME, r"all rights reserved"),
    ("reserved", "reserved", HINT, r"rights reserved"),
    ("proprietary", "proprietary", HINT, r"proprietary(?: and confidential| software| licen[sc]e)?"),
    ("proprietary", "permission", NAME, r"(?:without|with) (?:the )?(?:prior )?written permission"),
    ("proprietary", "reproduced", NAME, r"may not be (?:copied|reproduced|distributed)[a-z ]{0,40} reproduced"),
    ("no-warranty", "warranty", HINT, r"without warranty of any kind"),
    ("no-warranty", "warranties", HINT, r"without warranties or conditions of any kind"),
    ("non-commercial", "commercial", NAME, r"(?:for )?non commercial use only"),
    ("non-commercial", "noncommercial", NAME, r"noncommercial use only"),
    ("unnamed", "license", HINT, r"license"),
    ("unnamed", "licence", HINT, r"licence"),
    ("unnamed", "licenses", HINT, r"licenses"),
    ("unnamed", "licensed", HINT, r"licensed under"),
    ("unnamed", "spdx", HINT, r"spdx license identifier"),
]


@dataclass(frozen=True)
class Rule:
    """A signature: what it says, the word every match holds, its class, its pattern."""

    label: str
    keyword: str
    level: int
    pattern: str
    base: bool = False


def signature_rules() -> list[Rule]:
    """All rules in their order: base phrases, notices, short identifiers, phrases, names, hints."""
    rules = [
        Rule(label, max(phrase.split(), key=lambda w: (w == "cc", len(w))), NAME, phrase, True)
        for phrase, label in BASE.items()
    ]
    cc = []
    for rights, pattern in CC_RIGHTS.items():
        for version in CC_VERSIONS:
            label = f"cc-{rights}-{version.replace(' ', '.')}"
            cc.append((label, "cc", rf"cc {pattern}(?: licen[sc]e)? (?:version |v ?)?{version}"))
            cc.append((label, "commons", rf"creative commons {pattern}(?: licen[sc]e)? (?:version |v ?)?{version}"))
    for rights, pattern in CC_RIGHTS.items():
        cc.append((f"cc-{rights}", "cc", rf"cc {pattern}(?: licen[sc]e)?"))
        cc.append((f"cc-{rights}", "commons", rf"creative commons {pattern}(?: licen[sc]e)?"))
    named = [*NAMES, *cc]
    for template in NOTICES:
        rules += [Rule(label, key, NOTICE, template.format(f"(?:{body})")) for label, key, body in named]
    rules += [Rule(label, key, NOTICE, SHORT_NOTICE.format(body)) for label, key, body in SHORT]
    rules += [Rule(label, key, level, body) for label, key, level, body in PHRASES if level == NOTICE]
    rules += [Rule(label, key, NAME, body) for label, key, body in named]
    rules += [Rule(label, key, level, body) for label, key, level, body in PHRASES if level != NOTICE]
    return rules


def word_pattern(rule: Rule) -> str:
    """The rule's pattern, held to whole words of the joined text."""
    return rf"(?<![^ ])(?:{rule.pattern})(?![^ ])"


RULES = signature_rules()


def _rules_column(rules: list[Rule]) -> Column:
    """The rules as a constant array, in order."""
    rows = [
        F.struct(
            F.lit(number).alias("number"),
            F.lit(rule.level).alias("level"),
            F.lit(rule.base).alias("base"),
            F.lit(rule.label).alias("label"),
            F.lit(rule.keyword).alias("keyword"),
            F.lit(word_pattern(rule)).alias("pattern"),
        )
        for number, rule in enumerate(rules)
    ]
    return F.array(*rows)


def _places(joined: Column, rule: Column) -> Column:
    """The rule's matches as (start, -end, number, level, base, label), in words from 0."""
    pattern = rule["pattern"]
    marked = F.split(F.regexp_replace(joined, pattern, F.lit("\u0001$0")), " ", -1)
    numbered = F.transform(marked, lambda word, i: F.when(F.startswith(word, F.lit("\u0001")), i))
    starts = F.filter(numbered, lambda i: i.isNotNull())
    matches = F.regexp_extract_all(joined, pattern, F.lit(0))

    def place(start: Column, match: Column) -> Column:
        blanks = F.length(match) - F.length(F.replace(match, F.lit(" ")))
        return F.struct(
            start.alias("start"),
            (-(start + blanks + 1)).alias("back"),
            rule["number"].alias("number"),
            rule["level"].alias("level"),
            rule["base"].alias("base"),
            rule["label"].alias("label"),
        )

    return F.zip_with(starts, matches, place)


_SPAN = "struct<start:int,stop:int,rule:int,level:int,label:string>"


# Detections that one array gathers; an array that grows is copied with every step.
GATHERED = 512


def _kept(found: Column) -> Column:
    """The detections that no other one suppresses, of a sorted array, taken in portions."""
    ends = ("end0", "end1", "end2")

    def state(kept: str, *values: Column) -> Column:
        none = F.array().cast(f"array<{kept}>")
        return F.struct(*[v.alias(n) for n, v in zip(ends, values, strict=True)], none.alias("kept"))

    def step(state: Column, d: Column) -> Column:
        end, level = -d["back"], d["level"]
        # end0, end1, end2: largest end so far of class 0, of 0 and 1, of all.
        above = F.when(level == 0, state["end0"]).when(level == 1, state["end1"]).otherwise(state["end2"])
        span = F.struct(
            d["start"].alias("start"),
            end.alias("stop"),
            d["number"].alias("rule"),
            level.alias("level"),
            d["label"].alias("label"),
        )
        return F.struct(
            F.when(level == 0, F.greatest(state["end0"], end)).otherwise(state["end0"]).alias("end0"),
            F.when(level <= 1, F.greatest(state["end1"], end)).otherwise(state["end1"]).alias("end1"),
            F.greatest(state["end2"], end).alias("end2"),
            F.when(end > above, F.concat(state["kept"], F.array(span))).otherwise(state["kept"]).alias("kept"),
        )

    def portion(whole: Column, part: Column) -> Column:
        done = F.aggregate(part, state(_SPAN, *[whole[n] for n in ends]), step)
        # Named, so that a portion is gone through once.
        return F.element_at(
            F.transform(
                F.array(done),
                lambda x: F.struct(
                    *[x[n].alias(n) for n in ends], F.concat(whole["kept"], F.array(x["kept"])).alias("kept")
                ),
            ),
            1,
        )

    starts = F.when(
        F.size(found) > 0, F.sequence(F.lit(1), F.size(found), F.lit(GATHERED))
    ).otherwise(F.array().cast("array<int>"))
    portions = F.transform(starts, lambda i: F.slice(found, i, F.lit(GATHERED)))
    begin = state(f"array<{_SPAN}>", *[F.lit(-1)] * 3)
    return F.aggregate(portions, begin, portion, lambda whole: F.flatten(whole["kept"]))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score``, ``spans``.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are their smallest
    and largest start, null without one; suppression does not touch them. ``spans`` are the detections
    left (start, stop in words, rule, class, label); ``labels`` are theirs and the base ones,
    distinct, sorted, comma-joined, empty without any. ``score`` is that of the highest class
    found: notice 1, name 0.8, hint 0.5, nothing 0. Null and empty texts have no words. Repeated rows are
    scanned each, null ids stay null, other columns are not read. A text of any length is one row's work, which
    grows with its words and detections.
    """
    rules = RULES if rules is None else rules
    keywords = F.array(*[F.lit(word) for word in sorted({rule.keyword for rule in rules})])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Full lower case finds every keyword that A-Z lower case finds, and splits alike.
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("words", words)
    rows = rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.array_intersect("words", keywords).alias("present"),
        "text",
    )
    exact = F.array_join(
        F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)), " "
    )
    rows = rows.select(
        "id", "n_words", "present", F.when(F.size("present") > 0, exact).otherwise("").alias("joined")
    )
    tried = F.filter(
        _rules_column(rules),
        lambda rule: F.array_contains("present", rule["keyword"]) & F.rlike("joined", rule["pattern"]),
    )
    found = F.flatten(F.transform(tried, lambda rule: _places(F.col("joined"), rule)))
    nothing = F.array().cast("array<struct<start:int,back:int,number:int,level:int,base:boolean,label:string>>")
    found = F.when(F.size("present") > 0, F.array_sort(found)).otherwise(nothing)
    rows = rows.select("id", "n_words", found.alias("found"))
    rows = rows.select(
        "id", "n_words", F.filter("found", lambda d: d["base"]).alias("base"), _kept(F.col("found")).alias("spans")
    )

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    best = F.array_min(F.transform("spans", lambda d: d["level"]))
    score = F.lit(0.0)
    for level, value in SCORES.items():
        score = F.when(best == level, value).otherwise(score)
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    base_labels = F.transform("base", lambda d: d["label"])
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("spans", lambda d: d["label"]))).alias("labels"),
        score.alias("score"),
        "spans",
    )

