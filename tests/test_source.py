"""Extractors on hand-written sources, and against the chunk table's own cuts."""

import pytest

from codeloam.extract import source as S

TS = """import { a, b } from './util';
import fs from 'node:fs';
export class AuthService {
  private limit = 3;
  constructor(private db: Db) { super(); }
  login(user: string): { ok: boolean } {
    const re = /[{(]+$/.test(user); // } not a brace
    const s = `text ${this.check(user)} } ${require('x')('y')}`;
    return this.db.find({ user, s: "}" });
  }
  check = (u: string) => validate(u) && new Foo(u);
  get size() { return 1; }
}
export default function () { return init(); }
async function outer<T>(x: T): Promise<T> {
  function inner() { return deep(); }
  await import('./lazy');
  return inner?.() ?? x;
}
const run = async (n: number) => { other(n); };
const api = { start: function () { boot(); }, stop() { halt(); } };
"""

PHP = r"""<?php
namespace App\Auth;
use App\Db\Pool as P;
use App\Log\{Writer, Reader};
function boot(int $n) { return helper($n); }
final class Login extends Base implements Gate {
    public function run($x) {
        self::check($x); parent::run($x); Other::make(); $this->check($x); $x->send();
        $s = "a } $x"; // }
        new Foo(bar());
        $sql = <<<SQL
        } SELECT (
        SQL;
        return check($s);
    }
    abstract protected function check($y);
}
interface Gate { public function run($x); }
trait Loud { function shout() {} }
"""


def test_ts_chunks():
    got = {c[0]: c for c in S.chunks_of("a.ts", TS)}
    assert list(got) == ["<anonymous>", "outer", "AuthService", "AuthService.login"]
    assert got["AuthService"][2].startswith("export class AuthService {") and got["AuthService"][2].endswith("}")
    assert got["AuthService.login"][2].startswith("login(user") and got["AuthService.login"][2].count("\n") == 4
    assert got["outer"][3] == ["./util", "node:fs"]
    assert (got["AuthService.login"][4], got["AuthService.login"][5]) == (6, 10)


def test_ts_calls():
    calls = S.ts_calls(TS)
    assert ("AuthService.login", "AuthService.check") in calls and ("AuthService.login", "find") in calls
    assert ("AuthService.login", "require") in calls and ("AuthService.login", "test") in calls
    assert ("AuthService.check", "validate") in calls and not any(b == "Foo" for _, b in calls)
    assert ("outer", "deep") in calls and ("outer", "import") in calls and ("outer", "inner") in calls
    assert ("run", "other") in calls and ("start", "boot") in calls
    assert not any(a in ("<anonymous>", "") for a, _ in calls)


def test_php_chunks_and_imports():
    got = {c[0]: c for c in S.chunks_of("a.php", PHP)}
    assert list(got) == ["App\\Auth\\boot", "App\\Auth\\Login", "App\\Auth\\Login::run", "App\\Auth\\Login::check", "App\\Auth\\Gate", "App\\Auth\\Gate::run", "App\\Auth\\Loud", "App\\Auth\\Loud::shout"]
    assert got["App\\Auth\\boot"][3] == ["App\\Db\\Pool", "App\\Log\\Writer", "App\\Log\\Reader"]
    assert got["App\\Auth\\Login::run"][2].startswith("    public function run") and got["App\\Auth\\Login::run"][2].endswith("}")
    assert S.chunks_of("plain.php", "just text") == [("plain.php", "file", "just text", [], 1, 1)]


def test_php_calls():
    calls = S.php_calls(PHP)
    run = "App\\Auth\\Login::run"
    assert ("App\\Auth\\boot", "helper") in calls
    for callee in ("App\\Auth\\Login::check", "App\\Auth\\Login::run", "Other::make", "send", "bar"):
        assert (run, callee) in calls
    assert not any(b == "Foo" for _, b in calls)


def test_global_code_comes_before_namespaces():
    got = [s.name for s in S.php_symbols("<?php\nnamespace A { function x() {} }\nnamespace { function y() {} }")]
    assert got == ["y", "A\\x"]


@pytest.mark.parametrize("text", ["", "   ", "}}}{{{", "`${`${", "class", "function (", "'unterminated", "/* open", "a" * 20_000, "{" * 3000])
def test_odd_texts_do_not_fail(text):
    for name in ("a.ts", "a.php"):
        S.chunks_of(name, text), S.ranges_of(name, text)
    S.ts_calls(text), S.php_calls("<?php " + text)


def test_cuts_equal_the_tables(spark, data_dir):
    from pyspark.sql import functions as F

    from codeloam.plans import registry

    c = spark.read.parquet(f"{data_dir}/code_chunks.parquet")
    stored = c.where("lower(type) IN ('function', 'class', 'method') AND symbol IS NOT NULL AND length(code) > 0").select("project", "file", "symbol", F.sha2(F.regexp_replace("code", r"^\s+|\s+$", ""), 256).alias("h"))
    own = S.extract_chunks(c.where("lower(type) = 'file'").select("project", "file", F.col("code").alias("text")).distinct(), ["project"])
    joined = stored.distinct().join(own.select("project", "file", "symbol", F.sha2(F.regexp_replace("code", r"^\s+|\s+$", ""), 256).alias("mine")), ["project", "file", "symbol"], "left")
    total, same = joined.agg(F.count("*"), F.count(F.when(F.col("h") == F.col("mine"), 1))).first()
    assert total > 20 and same >= 0.97 * total
    assert registry.queries()["extracted_edges"](spark, data_dir).count() > 0
