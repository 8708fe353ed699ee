"""Turtle sources and code graphs of several languages."""

import pytest

from pyspark.sql import functions as F

from recollect.operators import codegraph
from recollect.sources import loaders, turtle

TYPE = turtle.RDF + "type"


def said(text, **options):
    return turtle.Turtle(text, **options).out


def test_turtle_forms():
    head = "@prefix e: <http://e/> . @prefix : <http://d/> ."
    assert said(head + 'e:a a :T, :U ; :p "x"@en-GB ; ; :q 1.5e3, -2, true .') == [("http://e/a", TYPE, "http://d/T", False), ("http://e/a", TYPE, "http://d/U", False), ("http://e/a", "http://d/p", "x", True), ("http://e/a", "http://d/q", "1.5e3", True), ("http://e/a", "http://d/q", "-2", True), ("http://e/a", "http://d/q", "true", True)]
    assert said("BASE <http://b/c/> <x> <../y> <#z> .") == [("http://b/c/x", "http://b/y", "http://b/c/#z", False)]
    assert [o for *_, o, _ in said(head + r''':s :p "a\"é\n", 'it''s' . '''.replace("it''s", "its"))] == ['a"é\n', "its"]
    assert said(head + ':s :p """two\n"lines" \\" here""" .')[0][2] == 'two\n"lines" " here'
    assert said(head + "[] :p [ :q e:x ] .") == [("_:b1", "http://d/p", "_:b2", False), ("_:b2", "http://d/q", "http://e/x", False)]
    assert said(head + "[ :p 1 ] . _:n :p () .", scope="f#") == [("_:f#b1", "http://d/p", "1", True), ("_:f#nn", "http://d/p", turtle.RDF + "nil", False)]
    assert sorted(t[1].rsplit("#", 1)[-1] for t in said(head + ":s :p (1 2) .")) == ["first", "first", "http://d/p", "rest", "rest"]
    assert said(head + "e:a.b :c%20d e:x\\,y. # end") == [("http://e/a.b", "http://d/c%20d", "http://e/x,y", False)]
    assert said("") == [] and said("# only a comment") == []


@pytest.mark.parametrize("text", ["x:a x:b x:c .", "<a> <b>", "<a> <b> <c>", "<a> .", "@prefix a <b> .", "<a> <b> \"open .", "<a> <b> ] .", '"s" <p> <o> .', "<a> <b> <c> ; <d> , <e> ."])
def test_turtle_refuses(text):
    with pytest.raises(turtle.TurtleError):
        said(text)


def test_files_that_fail_and_labels(spark):
    files = spark.createDataFrame([("good", '<http://o/A> <http://www.w3.org/2004/02/skos/core#prefLabel> "A", "B" .'), ("bad", "<"), ("none", None)], "path string, text string")
    found = turtle.triples(files)
    assert {(r.path, r.error is not None) for r in found.collect()} == {("good", False), ("bad", True)}
    assert [tuple(r) for r in turtle.labelled(found.filter("error is null")).collect()] == [("http://o/A", "A", ["B"], None)]


def test_all_aliases_and_escapes_of_lines(spark):
    alt = "http://www.w3.org/2004/02/skos/core#altLabel"
    lines = [f'<http://o/A> <{alt}> "name {i:04d}" .' for i in range(1500)] + [f'<http://o/B> <{alt}> "say \\"hi\\" \\u00e9"@fr .']
    got = {r.uri: r for r in loaders.triples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got["http://o/A"].primary == "name 0000" and got["http://o/A"].aliases == [f"name {i:04d}" for i in range(1, 1500)]
    assert got["http://o/B"].primary == 'say "hi" é' and got["http://o/B"].aliases == []


TS = """import { a as b } from "./mod"; import def from 'lib'; import "side";
// class Hidden {}
/* function hidden() { x() } */
export interface Shape extends Base<T>, Other { area(): number; }
export abstract class Dog extends ns.Animal<string> implements Pet, Named {
  private s = "class Fake {";
  constructor(x: number) { super(x); this.init({a: 1}); }
  async bark(loud?: { level: number }): Promise<void> { if (loud) { console.log(`x {`); } return new Sound().play(); }
  get<T>(k: string): T { return load<T>(k); }
}
function* gen(n: number) { yield run(n); function inner() { deep(); } inner(); }
const arrow = (x: number): number => twice(x);
export const big = async (f) => { await go(f); };
let v = call();
"""
GO = """package main
import ("fmt"; m "math/rand"
 "os")
type Animal interface { Name() string }
type ( A struct { x int }
 B = A
 C func() )
func (d *Dog) Bark(n int) (string, error) { fmt.Println("a {", n); helper(d.name); go func() { later() }(); return `raw {`, nil }
func helper(s string, v interface{}) interface{} { if len(s) > 0 { other() }; return A{x: 1} }
func Map[T any](xs []T, f func(T) T) []T { return apply(f) }
"""
RUST = """use std::collections::{HashMap, hash_map as hm};
pub struct P<T> { x: T }
struct U; struct T3(i32);
enum E { A { b: i32 }, C(String) }
pub trait Area: Shape + Debug { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * two() } }
impl<T: Clone> Area for P<T> { fn area(&self) -> f64 { let c = '{'; let s = r#"fn no() {"#; println!("{}", c); compute::<f64>(self.x) } }
impl P<i32> { pub fn new(x: i32) -> Self { let f = |y| inner(y); std::mem::swap(f); vec![1]; Self { x } } }
fn main<'a>(v: &'a str) where V: Fn(i32) -> i32 { P::new(1).area(); }
"""


def test_symbols_of_languages():
    def read(path, text):
        nodes, edges = codegraph.symbols(path, text)
        of = lambda kind: {(a.removeprefix("d.m").removeprefix("."), b) for k, a, b in edges if k == kind}
        return {(k, q.removeprefix("d.m.")) for k, q, _ in nodes if k in ("CLASS", "FUNCTION")}, {n for k, _, n in nodes if k == "IMPORT"}, of("INHERITS"), of("CALLS")

    kinds, imports, bases, calls = read("d/m.ts", TS)
    assert kinds == {("CLASS", "Shape"), ("CLASS", "Dog"), *(("FUNCTION", f) for f in ("Shape.area", "Dog.constructor", "Dog.bark", "Dog.get", "gen", "gen.inner", "arrow", "big"))}
    assert imports == {"./mod", "lib", "side"} and bases == {("Shape", "Base"), ("Shape", "Other"), ("Dog", "Animal"), ("Dog", "Pet"), ("Dog", "Named")}
    assert calls == {("Dog.constructor", "init"), ("Dog.bark", "log"), ("Dog.bark", "Sound"), ("Dog.bark", "play"), ("Dog.get", "load"), ("gen", "run"), ("gen.inner", "deep"), ("gen", "inner"), ("arrow", "twice"), ("big", "go")}
    kinds, imports, bases, calls = read("d/m.go", GO)
    assert kinds == {*(("CLASS", c) for c in ("Animal", "A", "B", "C")), *(("FUNCTION", f) for f in ("Bark", "helper", "Map"))}
    assert imports == {"fmt", "math/rand", "os"} and calls == {("Bark", "Println"), ("Bark", "helper"), ("Bark", "later"), ("helper", "len"), ("helper", "other"), ("Map", "apply")}
    kinds, imports, bases, calls = read("d/m.rs", RUST)
    assert kinds == {*(("CLASS", c) for c in ("P", "U", "T3", "E", "Area")), *(("FUNCTION", f) for f in ("Area.area", "Area.twice", "P.area", "P.new", "main"))}
    assert imports == {"std::collections::{HashMap,hash_map as hm}"} and bases == {("Area", "Shape"), ("Area", "Debug"), ("P", "Area")}
    assert calls == {("Area.twice", "area"), ("Area.twice", "two"), ("P.area", "println"), ("P.area", "compute"), ("P.new", "inner"), ("P.new", "swap"), ("P.new", "vec"), ("main", "new"), ("main", "area")}
    for path in ("m.ts", "m.go", "m.rs"):
        assert codegraph.symbols(path, "}}} ((( ``` { class fn func \x00")[0][0] == ("MODULE", "m", "m") and len(codegraph.symbols(path, "")[0]) == 1


def test_small_sources_are_dealt_and_parsed_once(spark):
    """A small file is read by one task; its rows are worked on by all, and labels read triples that were kept."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.createDataFrame([(f"{i}.ts", f"function f{i}() {{ g(); }}", f'<http://o/{i}> <{turtle.LABELS[0]}> "n{i}" .') for i in range(40)], "path string, text string, ttl string").coalesce(1)
    found = turtle.triples(files.select("path", F.col("ttl").alias("text")))
    assert found.rdd.getNumPartitions() == tasks and codegraph.extract(files)[1].rdd.getNumPartitions() == tasks
    labels = turtle.labelled(found)
    assert "MapInArrow" not in labels._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.primary for r in labels.collect()) == sorted(f"n{i}" for i in range(40))


def test_a_source_of_many_triples_comes_in_several_batches(spark):
    text = "\n".join(f'<http://o/{i}> <{turtle.LABELS[0]}> "n{i}" .' for i in range(2 * turtle.BATCH + 7))
    files = spark.createDataFrame([("a.ttl", text), ("b.ttl", "<"), ("c.ttl", ""), ("d.ttl", '<http://o/d> <http://o/p> "x" .')], "path string, text string")
    got = {r.path: (r.n, r.pos, r.error) for r in turtle.triples(files).groupBy("path").agg(F.count("*").alias("n"), F.max("pos").alias("pos"), F.max("error").alias("error")).collect()}
    assert got == {"a.ttl": (2 * turtle.BATCH + 7, 2 * turtle.BATCH + 6, None), "b.ttl": (1, 0, "not understood at 0: '<'"), "d.ttl": (1, 0, None)}
