import random

import pytest

from codeloam.llm.provenance import NameModel, judge, judge_files, name_trigrams, template_like

HAND = """import { readOrder } from './orders';

export class {0}Service {
  private limit = 10;

  validate{0}(order, context) {
    // generated reports are stored by the caller
    if (!order.total) throw new Error('empty {1}');
    for (const line of order.lines) this.check{1}(line, context);
    return summarise{0}(order);
  }

  private check{1}(line, context) {
    const price = context.prices[line.item] || 0;
    return price * line.count > this.limit ? 'large' : 'small';
  }
}
"""
WORDS = "Order Invoice Basket Parcel Refund Ledger Voucher Carrier Depot Harbor Meter Silo Tariff Queue Beacon".split()
LIBRARY = "".join(f"export function widen{w}(rows, shape) {{\n  const part{w} = rows.map((r) => r.{w.lower()} * shape.{w.lower()}Factor);\n  return compress{w}(part{w}, shape.depth);\n}}\n" for w in WORDS)
MINI = "".join(f'var {a}{b}{i}=function(e){{var t={{}};for(var n in e)t[n]=e[n];return t}};' for i, (a, b) in enumerate(zip("QzXwKjVq", "xQzJkWvZ")))


def stub(n):
    return "".join(f"export class M{i} {{\n" + "".join(f"  {v}{w}(x) {{ return this._f({i}); }}\n" for w in WORDS[:6] for v in ("get", "set", "has", "clear")) + "}\n" for i in range(n))


CASES = {
    "hand/a.ts": (HAND.replace("{0}", "Order").replace("{1}", "Line"), None), "generated/b.ts": (HAND.replace("{0}", "Refund").replace("{1}", "Basket"), None), "vendor/notes.js": (HAND.replace("{0}", "Depot").replace("{1}", "Meter"), None),
    "header.js": ("// This generator writes \"@generated\" into its output.\n" + HAND.replace("{0}", "Silo").replace("{1}", "Queue"), None), "edit.js": ("// Do not edit the cache by hand, call flush instead.\n" + HAND.replace("{0}", "Tariff").replace("{1}", "Beacon"), None),
    "table.js": ("export const steps = [\n  { name: 'open gate', minutes: 5 },\n  { name: 'close gate', minutes: 7 },\n];\n" + HAND.replace("{0}", "Gate").replace("{1}", "Step"), None), "conf.json": ('{"name": "x", "integrity": "sha512-abcd"}', None), "none.js": (None, None), "empty.js": ("", None),
    "gen1.ts": ("// Code generated by order-gen. DO NOT EDIT.\nexport const a = 1;\n", "generated"), "gen2.php": ("<?php\n/* Diese Datei wurde von x-gen erzeugt, Änderungen gehen verloren. */\nclass A {}\n", "generated"), "stubs.ts": (stub(3), "generated"),
    "api.js": ("".join(f"export const load{w}UsingGET_{i} = (p) => call('{w}', p);\n" for i, w in enumerate(WORDS)), "generated"), "package-lock.json": ('{"lockfileVersion": 3, "packages": {}}', "generated"), "old.js": ('"use strict";\nvar __mix = (this && this.__mix) || function (t) { return t; };\nObject.defineProperty(exports, "__esModule", { value: true });\n', "generated"),
    "public/a.js": (MINI * 3, "minified"), "lib/copied.js": (LIBRARY, "third-party"), "any/where.js": ("/* (c) the widgetry contributors */\n" + HAND.replace("{0}", "Copy").replace("{1}", "Other"), "third-party"), "changed.js": (LIBRARY.replace("widenSilo", "enlargeSilo").replace("  return", "\treturn"), "third-party"),
    "rows.js": ("id;name;price\n" + "".join(f"{i};red box;{i}.5\n" for i in range(30)), "data"), "numbers.ts": ("module.exports = [\n" + "".join(f"  {i}.25, -{i}.75, {i * 7},\n" for i in range(40)) + "];\n", "data"), "blob.ts": ('export const image = "data:image/png;base64,' + "iVBORw0KGgo4Y7" * 60 + '";\n', None),
}


LICENCE = "".join(f" * {i}. Redistributions in any form must keep this notice, with no warranty of any kind.\n" for i in range(60))


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("js", f"/*\n{LICENCE} */\n// Code generated by order-gen. DO NOT EDIT.\nexport const a = 1;\n", "generated"), ("js", f"/*\n{LICENCE} * (c) 2020 the widgetry contributors\n */\nexport const a = 1;\n", "third-party"), ("js", f"/*\n{LICENCE} */\nexport const a = 1;\n", None),
        ("data", "# Code generated by order-gen. DO NOT EDIT.\n" + "# a setting\n" * 200 + "# builds the list\na: 1\n", "generated"), ("js", "// This tool writes: code generated by x-gen\n" + "// \n" * 99 + "// Code generated by order-gen. DO NOT EDIT.\nexport const a = 1;\n", "generated"),
    ],
)
def test_whole_head_comment_is_searched(kind, text, want):
    assert (judge(kind, text, None, None) or (None,))[0] == want


def test_files(spark):
    rng = random.Random(3)
    rows = [("p", f, "file", f, "x", code) for f, (code, _) in CASES.items()]
    rows += [("q", f"more/{i}.ts", "file", "s", "x", HAND.replace("{0}", rng.choice(WORDS) + rng.choice(WORDS)).replace("{1}", rng.choice(WORDS))) for i in range(150)]
    rows += [rows[-1], ("p", "gen1.ts", "method", "m", "x", "a() {}"), (None, "stubs.ts", "FILE", None, "x", CASES["stubs.ts"][0])]
    df = spark.createDataFrame(rows, "project string, file string, type string, symbol string, id string, code string").selectExpr("*", "1 AS class", "2 AS reason")
    lib = spark.createDataFrame([(1, LIBRARY), (2, None), (3, "")], "lib_id int, code string")
    got = {(r["project"], r["file"]): r["class"] for r in judge_files(df, lib).collect()}
    for f, (_, want) in CASES.items():
        if f != "blob.ts":
            assert got["p", f] == want, f
    assert got["p", "blob.ts"] in ("data", "minified") and got[None, "stubs.ts"] == "generated"
    assert all(v is None for (p, _), v in got.items() if p == "q")
    assert judge_files(df.limit(0), lib).count() == 0 and judge_files(df, lib.limit(0)).count() == len(got)


def test_name_model():
    from collections import Counter

    m = NameModel(name_trigrams(Counter(f"{v}{w}" for v in ("read", "write", "check") for w in WORDS)))
    assert m.cross_entropy("readOrder") < 2.5 < m.cross_entropy("Qx7z")
    assert NameModel({}).cross_entropy("a") > 0 and m.cross_entropy("") > 0


def test_template_names():
    assert not template_like([f"{v}{w}" for v, w in zip("read write check open join trim".split(), WORDS)]) and not template_like([])
    assert template_like([f"_rule_{i}" for i in range(9)])


@pytest.mark.parametrize("text", ["a" * 300_000, "\n" * 9999, "/*" * 9999, "1," * 50_000, "'" * 5000])
def test_long_and_odd_texts(text):
    from codeloam.llm.provenance import KnownPackages, judge

    for kind in ("js", "php", "data"):
        judge(kind, text, NameModel({"^ab": 1}), KnownPackages([LIBRARY, ""]))
