import hashlib
import re

from pyspark.sql import functions as F

from fixtures_llm import awkward, nothing  # noqa: F401
from synthlab.llm import licences as L


def test_equivalent_texts_share_a_digest(spark, nothing):
    mit = L.KNOWN[1][1]
    same = ["Copyright (c) 2019 A. Person\n" + mit, mit.upper().replace(",", " ;"),
            mit.replace("copyright holders", "Copyright Owners").replace("sublicense", "sub-licence").replace("\n", "\n\n  "),
            "/* " + mit.replace("\n", "\n * ") + " */\nAll rights reserved."]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(same)] + [(10, mit + " more"), (11, None), (12, ""), (13, "© 2020 x"), (14, mit), (14, mit),
         (None, mit), (15, "text\nreleased under the MIT licence!\nx\nLicensed under CC BY-NC 4.0\nReleased under the MIT License.")],
        "doc_id long, text string").withColumn("licence", F.lit("clash")).withColumn("digest", F.lit(1))
    rows = L.scan(docs, L.known_licences(spark)).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert all(by[i]["licence"] == "MIT" for i in [*range(4), 14, None]) and by[10]["licence"] is None
    empty = hashlib.sha256(b"").hexdigest()
    assert all(by[i]["text_digest"] == empty and by[i]["licence"] is None for i in (11, 12, 13))
    assert (by[15]["n_notices"], by[15]["notices"]) == (3, "CC-BY-NC-4.0,MIT")
    assert sum(r["doc_id"] == 14 for r in rows) == 2
    assert L.scan(nothing, L.known_licences(spark)).count() == 0


def test_shuffle_join_gives_the_same_and_plan_is_native(spark, awkward, monkeypatch):
    known = L.known_licences(spark)
    a = sorted(map(tuple, L.scan(awkward, known).collect()), key=str)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    out = L.scan(awkward, known)
    assert sorted(map(tuple, out.collect()), key=str) == a
    assert not re.search("Python|Pandas|ArrowEval", out._jdf.queryExecution().toString())


def test_catalogue_covers_common_licences_headings_and_notices(spark):
    whole = {name: (L.FOLDER / f"{name}.txt").read_text() for name in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    bsd = [t for n, t in L.KNOWN if n == "BSD-3-Clause" and "copyright holder nor" in t][0]
    want = [("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + L._MIT), ("Apache-2.0", whole["Apache-2.0"]),
            ("Apache-2.0", whole["Apache-2.0"].split("APPENDIX")[0]), ("GPL-2.0", whole["GPL-2"]), ("GPL-3.0", whole["GPL-3"]),
            ("LGPL-2.1", whole["LGPL-2.1"]), ("MPL-2.0", whole["MPL-2.0"]), ("CC0-1.0", whole["CC0-1.0"]), ("BSD-3-Clause", bsd),
            ("GPL-2.0", whole["GPL-2"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
                                                "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")),
            ("MIT", "Licensed under the MIT License"), ("BSD", "Released under the BSD License."), ("CC-BY-SA-4.0", "CC text\nThis work is "
             "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.")]
    docs = spark.createDataFrame(list(enumerate(t for _, t in want)), "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] or r["notices"] for r in L.scan(docs, L.known_licences(spark)).collect()}
    assert [got[i] for i in range(len(want))] == [n for n, _ in want]


def test_headers_are_dropped_prose_is_kept_and_wrapping_does_not_matter(spark):
    import duckdb
    import textwrap
    from synthlab.llm import oracle
    heads = ["Copyright Jane Doe 2020", "Copyright The Foo Authors", "Copyright: 2020 X", "Portions Copyright (c) 2020", "(c) Jane Doe 2020",
             "Copyright Holdern Ltd", "Copyright Theo Lib", "Copyright by Software People", "# Copyright (C) 2001 X", "© Jane"]
    prose = ["copyright", "copyright holders be liable", "copyright notice, this", "(c) You must retain", "copyrighted works", "copyright the",
             "copyright the software, and", "COPYRIGHT OWNER'S", "copyright treaty adopted on 20 December 1996", "copyright on 1 January 2001"]
    mit = L._MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS").replace("sublicense", "sub-license")
    apache = (L.FOLDER / "Apache-2.0.txt").read_text()
    flat = [" ".join(t.split()) for t in (mit, apache)]
    docs = [(f"{h}\n\n{L._MIT}", "MIT") for h in heads]
    docs += [(f"{p}\n{L._MIT}", None) for p in prose]
    docs += [(textwrap.fill(flat[0], w, break_on_hyphens=True), "MIT") for w in range(20, 90, 3)]
    docs += [("\n * ".join(textwrap.wrap(flat[0], w)), "MIT") for w in (30, 31, 32)]
    paragraphs = apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Foo").split("\n\n")
    docs += [("\n\n".join(textwrap.fill(" ".join(p.split()), w) for p in paragraphs), "Apache-2.0") for w in (40, 55, 72, 73, 74)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    scanned = L.scan(rows, L.known_licences(spark, [r for r in L.KNOWN if r[0] in ("MIT", "Apache-2.0") and len(r[1]) > 300])).collect()
    got = {r["doc_id"]: r["licence"] for r in scanned}
    wrong = [(docs[i][0][:60], got[i]) for i in got if got[i] != docs[i][1]]
    assert not wrong
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(docs)])
    twin = con.execute(f"SELECT i, sha256({oracle._ONE_LINE.format(form=oracle._form('text'))}) FROM t").fetchall()
    assert dict(twin) == {r["doc_id"]: r["text_digest"] for r in scanned}
    headers = {"c", "yyyy"}
    said = {w for _, t in L.KNOWN if len(t) > 300 for w in re.findall(r"copyright[^\w\n]+(\w+(?: \w+)?)", " ".join(t.lower().split()))}
    assert {w.split()[0] for w in said if re.match(L._other_than(L.PROSE), w)} <= headers
