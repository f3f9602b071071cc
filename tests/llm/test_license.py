import re
import time

from helpers import SF, awkward, empty
from pyspark.sql import functions as F

from pricewake.llm import license as lic

PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = str.maketrans(lic.UPPER, lic.LOWER)


def brute(text):
    words = PLAIN.findall((text or "").translate(ASCII))
    base = [
        (i, label)
        for phrase, label in lic.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    line, found = " ".join(words), []
    for number, rule in enumerate(lic.RULES):
        for m in re.finditer(lic.word_pattern(rule), line):
            start = line[: m.start()].count(" ")
            found.append((start, start + len(m[0].split(" ")), number, rule.level, rule.label))

    # No rule matches more words than this; only what starts near can contain a detection.
    near = {}
    for e in found:
        near.setdefault(e[0] // 100, []).append(e)
    assert all(e[1] - e[0] < 100 for e in found)

    def suppressed(d):
        return any(
            e != d
            and e[0] <= d[0]
            and e[1] >= d[1]
            and e[3] <= d[3]
            and not (e[:2] == d[:2] and e[3] == d[3] and e[2] > d[2])
            for e in near.get(d[0] // 100, []) + near.get(d[0] // 100 - 1, [])
        )

    kept = sorted(d for d in found if not suppressed(d))
    score = {None: 0.0, 0: 1.0, 1: 0.8, 2: 0.5}[min((d[3] for d in kept), default=None)]
    base_labels = sorted({label for _, label in base})
    return (
        len(words),
        len(base),
        min((i for i, _ in base), default=None),
        max((i for i, _ in base), default=None),
        ",".join(base_labels),
        ",".join(sorted({*base_labels, *(d[4] for d in kept)})),
        score,
        kept,
    )


TEXTS = [
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.\nAll rights\n\treserved!",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
    "cc by cc by cc BY-SA 3.0, cc-by",
    "SPDX-License-Identifier: Apache-2.0",
    "SPDX-License-Identifier: GPL-2.0 or LGPL v2.1, see http://www.apache.org/licenses/LICENSE-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy ... without warranty of any kind",
    "dual licensed under the terms of the Mozilla Public License 2.0 and the Affero General Public License v3",
    "mit der Lizenz; mit license; Mitlicense; accby; cc bye; ccby",
    "licenKe cc Kby CC0 1.0 universal",
    "Copyright (c) 2019 2020 X. All rights reserved. may not be copied, modified or reproduced",
    "cc by " * 3000,
]


def test_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in docs]
    got = {r.doc_id: r for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for i, text in rows:
        r = got[i]
        spans = [(s.start, s.stop, s.rule, s.level, s.label) for s in r.spans]
        assert (*r[1:8], sorted(spans)) == brute(text), text
        seen.update(r.labels.split(","))
    assert got[11].n_base == 3000 and got[11].last_word == 5998
    assert {"cc-by", "cc-by-nc-4.0", "gpl", "gpl-3.0", "mit", "apache-2.0", "reserved", "mpl-2.0"} <= seen


def test_time_per_detection_is_flat(spark):
    """Detections of which each stays: a text of a hundred thousand takes no more for one than a short one."""
    seconds = {}
    for n in (5_000, 100_000):
        df = spark.createDataFrame([(1, "cc by " * n)], "doc_id long, text string")
        lic.scan_licenses(df.limit(0)).count()
        start = time.perf_counter()
        row = lic.scan_licenses(df).select("n_base", F.size("spans").alias("spans")).first()
        seconds[n] = time.perf_counter() - start
        assert row.n_base == n and row.spans >= n
    assert seconds[100_000] < 12 * seconds[5_000] + 20, seconds


def test_rules_hold_their_keyword():
    assert len(lic.RULES) > 300
    whole = r"(?<![a-z0-9]){}(?![a-z0-9])"
    for rule in lic.RULES:
        # Without its optional and alternative parts, or with each alternative, the word is there.
        required = re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\(\?:[^()]*\([^()]*\)[^()]*\)\?", "", rule.pattern))
        assert re.search(whole.format(re.escape(rule.keyword)), required), rule


def test_awkward(spark):
    got = lic.scan_licenses(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert (r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) == (0, 0, None, "", "", 0.0)
    assert lic.scan_licenses(empty(spark)).count() == 0


# Identifiers as they stand behind "SPDX-License-Identifier:", one at least for each label of NAMES with one.
SPDX = {
    "MIT": "mit", "MIT-0": "mit-0", "Apache-1.1": "apache-1.1", "Apache-2.0": "apache-2.0", "BSD-2-Clause": "bsd-2-clause",
    "BSD-3-Clause": "bsd-3-clause", "BSD-4-Clause": "bsd-4-clause", "0BSD": "0bsd", "GPL-1.0-only": "gpl-1.0",
    "GPL-2.0-or-later": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.0-only": "lgpl-2.0", "LGPL-2.1": "lgpl-2.1",
    "LGPL-3.0-only": "lgpl-3.0", "AGPL-3.0-only": "agpl-3.0", "GFDL-1.3": "gfdl", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0",
    "EPL-1.0": "epl-1.0", "EPL-2.0": "epl-2.0", "CDDL-1.0": "cddl-1.0", "CPL-1.0": "cpl-1.0", "EUPL-1.1": "eupl-1.1",
    "EUPL-1.2": "eupl-1.2", "Artistic-1.0": "artistic-1.0", "Artistic-2.0": "artistic-2.0", "ISC": "isc", "Zlib": "zlib",
    "Libpng": "libpng", "BSL-1.0": "bsl-1.0", "Unlicense": "unlicense", "WTFPL": "wtfpl", "PSF-2.0": "psf-2.0",
    "PHP-3.01": "php-3.01", "Ruby": "ruby", "PostgreSQL": "postgresql", "OpenSSL": "openssl", "NCSA": "ncsa", "MS-PL": "ms-pl",
    "MS-RL": "ms-rl", "OSL-3.0": "osl-3.0", "AFL-3.0": "afl-3.0", "OFL-1.1": "ofl-1.1", "ODbL-1.0": "odbl-1.0",
    "ODC-By-1.0": "odc-by", "PDDL-1.0": "pddl", "BUSL-1.1": "bsl-1.1", "SSPL-1.0": "sspl-1.0", "Elastic-2.0": "elastic-2.0",
    "CC0-1.0": "cc0-1.0", "CC-PDM-1.0": "cc-pdm", "CC-BY-4.0": "cc-by-4.0", "CC-BY-NC-SA-3.0": "cc-by-nc-sa-3.0",
}
# Families without a version, and names that are in no list of short identifiers.
NO_SPDX = {"apache", "bsd", "gpl", "lgpl", "agpl", "mpl", "epl", "eupl", "edl-1.0", "artistic", "openrail"}


def test_short_identifiers(spark):
    assert {label for label, _, _ in lic.NAMES} <= {*SPDX.values(), *NO_SPDX}
    forms = ["x\n// SPDX-License-Identifier: {}\ny", "License: {}", "It is licensed under {}.", "released under the {}"]
    rows = [(form.format(name), label) for name, label in SPDX.items() for form in forms]
    rows += [("Licensed under GPLv1.", "gpl-1.0"), ("under the gpl1 or not", "gpl-1.0"), ("see GPL v1", "gpl-1.0")]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    for r in lic.scan_licenses(docs).collect():
        text, label = rows[r.doc_id]
        assert label in r.labels.split(","), (text, r.labels)
        assert r.score == 1.0 or label == "gpl-1.0", (text, r.score)
    plain = ["They met at MIT, with zlib and ruby on postgresql.", "an isc epl bsl ofl"]
    for r in lic.scan_licenses(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")).collect():
        assert (r.labels, r.score) == ("", 0.0)


def language_of(tree):
    """Every text of a parsed pattern, repeats taken as few times as allowed and once more."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            part = [chr(arg)]
        elif op == "BRANCH":
            part = [x for branch in arg[1] for x in language_of(branch)]
        elif op == "SUBPATTERN":
            part = language_of(arg[3])
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            part = [x * n for x in language_of(inner) for n in {low, min(high, low + 1)}]
        else:
            assert op == "IN", op
            part = [chr(a) if str(kind) == "LITERAL" else chr(a[0]) if str(kind) == "RANGE" else "7" for kind, a in arg]
        out = [a + b for a in out for b in dict.fromkeys(part)]
    return out


def test_every_alternative_holds_its_keyword():
    """The prefilter tries a rule only where its keyword is a word, so every match must hold it."""
    for rule in lic.RULES:
        for text in language_of(re._parser.parse(rule.pattern)):
            assert rule.keyword in text.split(" "), (rule, text)
