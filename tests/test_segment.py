"""Heads of C and C++ functions as they occur, linear time, bounded batches."""

import time

import pytest

from quarry.operators import segment as S


def lines(code, **kw):
    return [(n, a, b) for n, a, b, _ in S.find_functions(code, **kw)]


C = [
    ("int f(a, b)\n int a;\n char *b;\n{ return a; }", [("f", 1, 4)]),
    ("main(argc, argv)\nint argc; char **argv;\n{\n}", [("main", 1, 4)]),
    ("int f(x, cb)\nint x; int (*cb)();\n{ }", [("f", 1, 3)]),
    ("int f(a) MACRO;\nint g(void) { }", [("g", 2, 2)]),
    ("__attribute__((noinline)) static int h(void) { }", [("h", 1, 1)]),
    ("static __inline__ unsigned long long int *f(void)\n__attribute__((pure))\n{ }", [("f", 1, 3)]),
    ("int f(void) UNUSED_MACRO(x) { }", [("f", 1, 1)]),
    ("EXPORT(int) foo(void) { }", [("foo", 1, 1)]),
    ("STATIC_ASSERT(x)\nint h(void) { }", [("h", 2, 2)]),
    ('MODULE_LICENSE("GPL")\nstatic int __init h(void) { }', [("h", 2, 2)]),
    ("MODULE_AUTHOR(name)\nint g(void) { }", [("g", 2, 2)]),
    ("DEFINE_FN(foo) { }", []),
    ("SYSCALL_DEFINE3(read, int, fd) { }\nint x(void) {}", [("x", 2, 2)]),
    ("f(x) { }", [("f", 1, 1)]),
    ("struct S *mk(struct S *p) { }", [("mk", 1, 1)]),
    ("typedef struct { int a; } T;\nT f(T t) { for (;;) { } }", [("f", 2, 2)]),
    ("void (*signal(int s, void (*f)(int)))(int) { }", [("signal", 1, 1)]),
    ("foo_t (*cb(int x))(int) { }", [("cb", 1, 1)]),
    ("int (f)(int x) { }", [("f", 1, 1)]),
    ("int (*fp)(int) = 0;\nint g(void) { }", [("g", 2, 2)]),
    ("int a = f(x) + 1; int b(void) { }", [("b", 1, 1)]),
    ("static const struct ops o = {\n .read = foo,\n};\nint q(void) { }", [("q", 4, 4)]),
    ("enum class E : int { A = 1 };\nstruct S { int a; } s = { 1 };\nunion { int x; };\nint t[] = { 1, 2 };\nauto l = [](int x) { return x; };", []),
    ("else if (x) { } return foo(x) { }", []),
    ("int f(void)\n{\n}\n}\nint g(void) {}", [("f", 1, 3), ("g", 5, 5)]),
]
CPP = [
    ("A::B::f(int x) const { }\nA<T>::g() { }\nA::~A() { }\nbool A::operator==(const A& o) const { }\nint A::operator()(int x) { }", [("A::B::f", 1, 1), ("A::g", 2, 2), ("A::~A", 3, 3), ("A::operator==", 4, 4), ("A::operator()", 5, 5)]),
    ("class Foo : public Bar<int> {\npublic:\n Foo(int x) : a(x), b{1}, c{f(2)} { }\n ~Foo() { }\n int m() const override { }\n operator bool() { }\n};", [("Foo", 3, 3), ("~Foo", 4, 4), ("m", 5, 5), ("operator bool", 6, 6)]),
    ("class X { X(int a) { } };\nclass ABC { ABC() { } DEF() { } };", [("X", 1, 1), ("ABC", 2, 2)]),
    ("Foo::Foo(int x)\n  : Base<int>(x), a{x}\n{\n}", [("Foo::Foo", 1, 4)]),
    ("template <class T, int N = (1 > 2)>\nT max(T a, T b) { }", [("max", 2, 2)]),
    ("template<> void A<int>::h<int>(int) { }", [("A::h", 1, 1)]),
    ("auto f(int x) -> decltype(x) { }", [("f", 1, 1)]),
    ("int f() try { } catch (...) { }\nint g() {}", [("f", 1, 1), ("g", 2, 2)]),
    ("namespace a::b { inline namespace c { int f() { } } }\nint g() {}", [("f", 1, 1), ("g", 2, 2)]),
    ("std::map<int, std::vector<int>> f(std::vector<int> v = {1, 2}) { }", [("f", 1, 1)]),
    ("std::ostream& operator<<(std::ostream& o, const A& a) { }", [("operator<<", 1, 1)]),
    ("void* operator new(size_t n) { }", [("operator new", 1, 1)]),
    ("class __attribute__((packed)) EXPORT_API(x) Foo { int f() { } };", [("f", 1, 1)]),
    ('[[nodiscard]] int f() { } extern "C" int g() { }', [("f", 1, 1), ("g", 1, 1)]),
]
TEXT = [
    ('const char *s = R"x(} { int q() {)x";\nint g(void) { char c = \'{\'; }', [("g", 2, 2)]),
    ("int x = 1'000'000; char f(void) { int y = 0xFF'FF; }", [("f", 1, 1)]),
    ("auto (f)(int x) { char c = u8'{'; }", [("f", 1, 1)]),
    ("#define X { \\\n {\nint g(void) {\n#if A\n if (x) {\n#else\n if (y) {\n#endif\n }\n}", [("g", 3, 10)]),
    ("#if A\nint a(void) { }\n#else\nint b(void) { }\n#endif", [("a", 2, 2), ("b", 4, 4)]),
    ("#ifdef A\n#if B\nint a() {\n#endif\n#endif\n}\nint c() {}", [("a", 3, 6), ("c", 7, 7)]),
    ("#if A\n{ {\n#elif B\n#if C\n}\n#else\n#endif\n}\n#endif\n} }\nint z() {}", [("z", 11, 11)]),
    ("#define S \"/*\" // x\nint f(void) { /* \" */ }", [("f", 2, 2)]),
    ("int f(void) { // }\\\n }\n}", [("f", 1, 3)]),
    ("int f(void) {", []),
    ("", []),
]


@pytest.mark.parametrize("code,want", C + CPP + TEXT)
def test_heads(code, want):
    assert lines(code) == want


def test_code_and_shallow_names():
    code = "/* c */ template <class T>\nstatic T f(T t) { return t; } // x\nchar *g(void) { }\nA::h() { }\nclass X { int m() { } X() { } };"
    assert [c for *_, c in S.find_functions(code)] == ["static T f(T t) { return t; }", "char *g(void) { }", "A::h() { }", "int m() { }", "X() { }"]
    assert [n for n, *_ in S.find_functions(code, "shallow")] == ["f", "anonymous", "anonymous", "anonymous", "X"]


LONG = {
    "one word": lambda n: "int " + "a" * n + " {",
    "words": lambda n: "x " * (n // 2) + "{",
    "brackets": lambda n: "(" * n + "{",
    "functions": lambda n: 'int f(void) { if (x) { y = "s"; } /* c */ }\n' * (n // 44),
    "old style": lambda n: "int f(a) " + "int a; " * (n // 7),
    "initialisers": lambda n: "F::F(x) : a" + "{1}, b" * (n // 6),
    "angles": lambda n: "a < " * (n // 4) + "{}",
    "raw strings": lambda n: 'R"(' * (n // 3),
    "macros": lambda n: "F(x)\n" * (n // 5) + "{",
    "comments": lambda n: "/*" * (n // 2),
    "quotes": lambda n: "'" * n + '"' * n,
    "hashes": lambda n: "#if A\n" * (n // 6),
}


@pytest.mark.parametrize("kind", LONG)
def test_time_grows_with_the_text(kind):
    def took(n):
        text, t = LONG[kind](n), time.process_time()
        S.find_functions(text)
        return time.process_time() - t

    short, long = min(took(60_000) for _ in range(3)), min(took(240_000) for _ in range(2))
    assert long < 10 * short + 0.05  # four times the text; 16 times if the square


def test_batches_are_bounded_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 40)
    rows = [("a.c", "int f(void) { return 1; }\n" * 9), ("b.c", None), ("c.c", ""), ("a.c", "int g(void) { }"), (None, "int h(void) { }")]
    files = spark.createDataFrame([(*r, "x") for r in rows], "path string, content string, code string").coalesce(1)
    got = [(r.file_path, r.function_name) for r in S.segment_units(files).collect()]
    assert got == [("a.c", "f")] * 9 + [("a.c", "g"), (None, "h")]
    assert S.segment_units(files.limit(0)).collect() == []
