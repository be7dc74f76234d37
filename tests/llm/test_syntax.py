import pytest

from codeloam.llm.parsing import parse_files, parse_rates
from codeloam.llm.syntax import LANGUAGES, fault

VALID = [
    ("js", "#!/usr/bin/env node\n'use strict';\nconst { a, b: [c] } = f`x${`y${1}`}`;\nlabel: for (const x of y) { if (/[/]}/.test(x)) continue label; }\nexport default class A extends B { #p = 1; static async *gen() { yield* this.#p; } get = 1; set(v) {} }\nx = a ? b : c ?? d?.e;\nreturnValue = 1 / 2 / 3;"),
    ("js", "import * as x from 'y';\nimport d, { default as q } from 'z';\nexport * from './a';\nswitch (a) { case b: { break } default: c() }\nlet i = 0\ni++\n++i\nif (a) b(); else c()\ndo { } while (0)\nasync () => { await x; for await (const y of z); }\nvar v = typeof x === 'a' ? { b: 1 } : [ , 2, ];"),
    ("js", "// <<<<<<< not here\n/*\n<<<<<<< nor here\n=======\n*/\nconst s = `\n>>>>>>> text\n`;\nconst r = a < b && c > d;\nx = y\n/re/.test(z)"), ("js", "\ufeffconst a = 1;\r\nconst b = { if: 1, class: 2 }.if;\r\n"), ("js", "const b = (x) => ({ ...x, y: 1 });\n!function (e) { e.a = 1 }({});var q=!0,w=void 0;"),
    ("ts", "abstract class A<T extends B = C> implements D { private readonly x?: string; constructor(public y: number) { super(); } abstract z(): void; get w(): Map<string, Array<number>> { return this.y as unknown as any; } }\ntype U = { [k in keyof T]?: T[k] } | 'a' | null;\nenum E { A = 1, B }\ndeclare module 'm' { export const x: number; }\nfunction isA(x: any): x is A { return x! instanceof A; }\nconst f = <T,>(a: T): T => a; const g = <string>h; let x: string | undefined = y satisfies Z;\nexport interface P { (a: number): string; new (b: string): P; readonly c?: () => void }"),
    ("tsx", "export function A<T>(p: { a: T }) { return (<><B.C x={1} y='2' {...p}>text {p.a} it's <br/> {/* c */}</B.C>{p.a && <D />}</>); }\nconst f = <T,>(a: T) => a;"), ("jsx", "const x = <div>{rows.map((r) => <Item key={r} a=\"}\" />)} &amp; done</div>;"),
    ("php", "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\n#[Attr(1)]\nfinal class G extends H implements I { use T; const X = 1; private ?int $y = null; public function __construct(private readonly array $z = [], int|string ...$rest) {} public static function s(): static { return new static(...); } }\n$x = match (true) { $a > 1 => 'a', default => throw new \\E('}') };\n$h = <<<EOT\n  } {$x['a']} text\n  EOT;\nforeach ($a ?? [] as $k => [$b, $c]): echo \"{$b}\"; endforeach;\n$f = fn (int $x): int => $x * 2;\nif ($a) $b = 1; elseif ($c) { $d = (int) $e; }\n$o?->p()->q::R; ?>\n<b>html</b>\n<?= $x ?>"),
    ("php", "just text, no code {{{"), ("json", ' {"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}} '), ("json", "3"), ("yaml", "# c\na: 1\nb:\n- x\n- y: 2\n  z: [1, {q: 'it''s'},\n    3]\nc: |\n  any: [thing\n  - here\nd: \"multi\n  line\"\ne: plain text\n  goes on\nf: {}\ng: &anchor\n  h: *anchor\n? complex\n: value\nurl: http://x:1/a#b\n"), ("yaml", "---\n- a\n- - b\n  - c\n-\n  d: 1\n---\nplain\n...\n"), ("yaml", "a:\n  - \"X=1\"\n  # note\n  - 'y: z'\nkey with spaces: v # comment"),
    ("toml", "a = 1\n[b.c]\nd = [\n  1, # c\n  2,\n]\ns = '''\n] {\n'''\n[[e]]\nf = { g = \"h\" }\n"), ("xml", '<?xml version="1.0"?><!DOCTYPE a><a b="1"><!-- <c> --><![CDATA[<d>]]><e/>&lt;</a>\n'), ("sh", "#!/bin/bash\nf() { local x=\"$(echo \"a)\" ${y:-b})\"; }\nif [ -f x ] && [[ $a == (b|c) ]]; then echo 'it'; elif true; then :; else exit 1; fi\nfor i in a b; do echo $i; done | sort\ncase \"$1\" in a|b) echo x ;; *) f ;; esac\ncat <<'EOF' > out\n if then ( \" \nEOF\nwhile read -r l; do ((n++)); done < <(ls)\narr=(1 2) # don't\necho done fi\n"), ("sh", "a() {\n  export X='1'\n}\n"),
]
BROKEN = [
    ("js", "function f() { return 1;"), ("js", "const a = [1, 2;"), ("js", "f(1));"), ("js", "}"), ("js", "const s = 'abc;\n"), ("js", "const s = `abc"), ("js", "/* open"), ("js", "const a = = 2;"), ("js", "const a b = 1;"), ("js", "export const x ="), ("js", "if (f( {\n}"), ("js", "<!DOCTYPE html>\n<html></html>"), ("js", "<?php\n$x = 1;"), ("js", "const e = {{ a.b }};"), ("js", "interface A { b: number; }"), ("js", "function f(a: string) {}"), ("js", "const a: number = 1;"), ("js", "const x = <div/>;"), ("js", "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n"), ("js", "f();\n>>>>>>> abc123\ng();"), ("js", "id,name,n\n1,two words,3"), ("js", "# comment\nkey: value"),
    ("ts", "const v = <div className=\"a\">x</div>;"), ("ts", "const n = ‘x’;"), ("ts", "class A {\n  m(): void {\n}\n"), ("tsx", "const a = <div><span></div>;"), ("jsx", "const a = <section className=\"b\">\n"), ("jsx", "const a: number = 1;"),
    ("php", "<?php function f() {"), ("php", "<?php $a = [1, 2;"), ("php", "<?php f(1)); "), ("php", "<?php $a b = 1;"), ("php", "<?php $a = = 1;"), ("php", "<?php $s = 'x;\n"), ("php", "<?php $h = <<<SQL\nSELECT 1"), ("php", "<?php\n$a = 1\n$b = 2;"), ("php", "<?php\nfunction f() { return 1 }"), ("php", "<?php\n=======\n"), ("php", "<?php $x = {{ a.b }};"),
    ("json", '{"a": 1,}'), ("json", "{'a': 1}"), ("json", '{"a": 1 // c\n}'), ("json", '{"a": NaN}'), ("json", '{"a": 1'), ("json", """ {"a": "x\ny"}"""), ("json", '{"a" 1}'), ("json", "{} {}"), ("yaml", "a: [1, 2\n"), ("yaml", "a: 1\n- b\n"), ("yaml", "a: \"x\nb: 1"), ("yaml", "a: b: c"), ("yaml", "a:\n   b: 1\n  c: 2"), ("yaml", "a: 1\njust text\nb: 2"), ("yaml", "a:\n\tb: 1"), ("yaml", "a: 1\n<<<<<<< ours\nb: 2"),
    ("toml", "a = "), ("toml", "[a\nb = 1"), ("toml", "a b = 1"), ("toml", "= 40"), ("toml", 'a = "x'), ("toml", "a = 1\na = 2"), ("xml", "<a><b></a>"), ("xml", "<a>"), ("xml", "<a></a"), ("xml", "<a/><b/>"), ("xml", "<a>\n<<<<<<< HEAD\n</a>"), ("sh", "if true; then echo"), ("sh", "for x in a; do echo $x\n"), ("sh", "echo 'abc"), ("sh", "f() {\n"), ("sh", "fi"), ("sh", "cat <<EOF\nx"), ("sh", "a\n<<<<<<< HEAD\nb"), ("sh", "echo $(ls"),
]


@pytest.mark.parametrize(("ending", "text"), VALID)
def test_valid(ending, text):
    assert fault(ending, text) is None


@pytest.mark.parametrize(("ending", "text"), BROKEN)
def test_broken(ending, text):
    reason = fault(ending, text)
    assert reason and reason[1] >= 1


@pytest.mark.parametrize("text", ["(" * 20_000, "{" * 20_000 + "}" * 20_000, "a" * 300_000, "\n" * 10_000, "'" * 9999, "\x00", "<" * 3000, "`${" * 2000])
def test_long_and_odd_texts(text):
    for ending in LANGUAGES:
        fault(ending, text)


def test_table(spark):
    rows = [
        ("p", "a.js", "file", "a.js", "x", "f("), ("p", "a.js", "FILE", None, "x", "f("), ("p", "b.js", None, "b.js", "x", "f();"), ("p", "dir\\c.JSON", "File", "dir\\c.JSON", "x", "{"), ("p", "d.md", "file", "d.md", "x", "("), ("p", "e.js", "file", "e.js", "x", None),
        ("p", "f.js", "file", "f.js", "x", ""), ("p", "g.js", "method", "m", "x", "m() {"), (None, "h.js", "file", "h.js", "x", "}"), ("p", None, "file", None, "x", "}"), ("q", "\ufeffi.ts", "file", "i", "x", "\ufeff"),
    ]
    df = spark.createDataFrame(rows, "project string, file string, type string, symbol string, id string, code string").selectExpr("*", "1 AS reason", "2 AS language")
    got = sorted((r["project"] or "", r["file"]) for r in parse_files(df).where("reason IS NOT NULL").collect())
    assert got == [("", "h.js"), ("p", "a.js"), ("p", "dir\\c.JSON")]
    rates = {(r["project"], r["language"]): (r["files"], r["invalid"], r["rate"]) for r in parse_rates(df).collect()}
    assert rates["p", "javascript"] == (2, 1, 0.5) and rates["p", "json"] == (1, 1, 1.0)
    assert parse_files(df.limit(0)).count() == parse_rates(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("ending", "text", "valid"),
    [
        ("php", "<?php\n$a = f($x)\nreturn $a;", False), ("php", "<?php\n$a = [1]\nforeach ($a as $b) {}", False), ("php", "<?php\n$f = function () use ($x) { return 1; };\nif ($a) return f(1) and g();", True), ("php", "<?php\nclass A { public run($x) {} }", False), ("php", "<?php\nrun($x) { return 1; }", False),
        ("php", "<?php\n$a = $b ? f($c) [0];", False), ("php", "<?php\nfunction f(?int $a): ?string { return $a ? 'x' : ($a ?: 'y'); }", True), ("php", "<?php\n$o = new class(1) extends B implements C { };", True), ("php", "<?php\nswitch ($a) { case 1: echo 'x'; break; default: g(); }", True),
        ("js", "switch (a) { case 'x'\n f(); break; }", False), ("js", "const f = (a) { return a; };", False), ("js", "f(a { b: 1 });", False), ("js", "export async function f() {}\nexport f() {}", False), ("js", "const { a, b } f(c);", False), ("js", "a ? b; c();", False),
        ("js", "class A extends m(B) { get x() { return 1; } static async *g(a) { } }\nif (a) { b() }\n{ c }", True), ("js", "const o = { f(a) { }, async g() { }, case: 1, default: 2 };", True), ("js", "for (const { a } of b) { }\nexport default class { }\nexport * from './x'", True), ("ts", "function f<T>(a?: T, b?): a is B { return a ? { c: 1 } : d; }\nabstract class A { private x?: string; constructor(@In() a: B,\n b: C) { super(); } }", True),
        ("ts", "type X = {\n a: string\n b?: number\n}\ndeclare module 'x' { function f(a: string): void }\nenum E { A, B }", True),
    ],
)
def test_missing_signs(ending, text, valid):
    assert (fault(ending, text) is None) is valid
