"""Calls resolved by imports, impl headers and types, on a small workspace with many equal names."""

from hypothesis import given
from hypothesis import strategies as st

from tarnwell.sources import names, parsers

LIB = """
pub mod shapes; mod util;
pub use shapes::{Circle, Square as Box2};
use util::*;
pub fn main() {
    let c = Circle::new(1);
    c.draw();
    let s: Box2 = make();
    s.draw();
    helper();
    show(&c);
    let v = unknown();
    v.size();
    let text = "helper2(); // no call"; /* fn no() { helper2() } */
    println!("{}", helper2());
    <Circle as shapes::Draw>::draw(&c);
}
pub fn show<T: shapes::Draw>(x: &T) { x.draw(); x.twice(); }
fn make() -> Box2 { Box2 { n: 1 } }
"""
SHAPES = """
use super::util as u;
pub trait Draw { fn draw(&self); fn twice(&self) { self.draw(); } }
pub struct Circle { r: i32, inner: Option<i32>, side: Square }
pub struct Square { n: i32 }
impl Circle { pub fn new(r: i32) -> Self { u::helper(); Self { r: r } } fn size(&self) -> i32 { self.side.size(); 1 } }
impl Draw for Circle { fn draw(&self) { self.size(); } }
impl<'a> Draw for Square { fn draw(&self) { crate::util::helper2::<i32>(); self.twice(); } }
impl Square { fn size(&self) { } }
"""
UTIL = """
pub fn helper() {}
pub fn helper2<A>() -> i32 { 'x'; Circle::make().run(); 1 }
pub struct Circle;
impl Circle { fn make() -> Runner { Runner } fn draw(&self) { } }
struct Runner;
impl Runner { fn run(&self) {} }
"""
OTHER = """
use a_lib::Circle;
use a_lib::shapes as sh;
fn run(c: &Circle, q: Box<dyn sh::Draw>) { c.draw(); q.draw(); a_lib::show(c); sh::Circle::new(2).size(); }
fn helper() { self::helper2(); }
fn helper2() {}
"""


def workspace(spark):
    rows = [("a_lib", "/w/a/src/lib.rs", LIB), ("a_lib", "/w/a/src/shapes.rs", SHAPES), ("a_lib", "/w/a/src/util/mod.rs", UTIL), ("b", "/w/b/src/main.rs", OTHER), ("b", "/w/b/src/none.rs", None), ("b", "/w/b/src/empty.rs", "")]
    return spark.createDataFrame(rows, "crate string, path string, text string")


def test_calls_name_one_function_where_the_type_is_known(spark):
    functions, calls = names.resolved_calls(names.source_names(workspace(spark)))
    label = {f.id: f"{(f.owner or f.module)}.{f.name}" + (f"/{f.trait}" if f.trait else "") for f in functions.collect()}
    assert len(label) == 18
    got = {(label[c.src], label[c.dst], c.how) for c in calls.collect()}
    circle, square, draw = "a_lib::shapes::Circle", "a_lib::shapes::Square", "/a_lib::shapes::Draw"
    want = {
        ("a_lib.main", circle + ".new", "path"), ("a_lib.main", circle + ".draw" + draw, "receiver"), ("a_lib.main", "a_lib.make", "path"),
        ("a_lib.main", square + ".draw" + draw, "receiver"), ("a_lib.main", "a_lib::util.helper", "path"), ("a_lib.main", "a_lib.show", "path"),
        ("a_lib.main", circle + ".size", "name"), ("a_lib.main", square + ".size", "name"), ("a_lib.main", "a_lib::util.helper2", "path"),
        ("a_lib.show", circle + ".draw" + draw, "trait"), ("a_lib.show", square + ".draw" + draw, "trait"), ("a_lib.show", "a_lib::shapes::Draw.draw", "trait"),
        ("a_lib.show", "a_lib::shapes::Draw.twice", "trait"),
        ("a_lib::shapes::Draw.twice", circle + ".draw" + draw, "trait"), ("a_lib::shapes::Draw.twice", square + ".draw" + draw, "trait"),
        ("a_lib::shapes::Draw.twice", "a_lib::shapes::Draw.draw", "trait"),
        (circle + ".new", "a_lib::util.helper", "path"), (circle + ".size", square + ".size", "receiver"), (circle + ".draw" + draw, circle + ".size", "receiver"),
        (square + ".draw" + draw, "a_lib::util.helper2", "path"), (square + ".draw" + draw, "a_lib::shapes::Draw.twice", "trait"),
        ("a_lib::util.helper2", "a_lib::util::Circle.make", "path"), ("a_lib::util.helper2", "a_lib::util::Runner.run", "receiver"),
        ("b.run", circle + ".draw" + draw, "receiver"), ("b.run", circle + ".draw" + draw, "receiver"), ("b.run", square + ".draw" + draw, "trait"),
        ("b.run", "a_lib::shapes::Draw.draw", "trait"), ("b.run", "a_lib.show", "path"), ("b.run", circle + ".new", "path"), ("b.run", circle + ".size", "receiver"),
        ("b.helper", "b.helper2", "path"),
    }
    assert got == want


def test_fewer_edges_than_by_name(spark):
    sources = workspace(spark)
    _, calls = names.resolved_calls(names.source_names(sources))
    everything = sources.selectExpr("'w' as w", "text")
    _, by_name = parsers.call_graph(parsers.parse_sources(everything, "w", "braces"), "w")
    assert calls.count() < by_name.count()


def test_circles_of_imports_and_globs_end(spark):
    rows = [("a", "src/lib.rs", "mod x; mod y; use x::*; fn f() { g(); h(); }"), ("a", "src/x.rs", "pub use super::y::*; pub use super::y::h;"), ("a", "src/y.rs", "pub use super::x::*; pub use super::x::h; pub fn g() {}")]
    functions, calls = names.resolved_calls(names.source_names(spark.createDataFrame(rows, "crate string, path string, text string")))
    label = {f.id: f.name for f in functions.collect()}
    assert [(label[c.src], label[c.dst], c.how) for c in calls.collect()] == [("f", "g", "path")]
    none = spark.createDataFrame([], "crate string, path string, text string")
    assert names.resolved_calls(names.source_names(none))[1].isEmpty()


@given(st.lists(st.sampled_from("fn f ( ) { } ; use a::b :: * as impl for trait T < > -> let x = : & . self struct # [ ] , \" ' /* mod".split()), max_size=60))
def test_reader_takes_any_text(parts):
    names.read_names(" ".join(parts))
