"""Names that reach a file through other files, classes and variables."""

import random

import pytest
from test_extract import graph_of

from switchboard.operators.hierarchy import follow, linearize


@pytest.fixture(params=["1000000", "1"], scope="module")
def calls_of(spark, request):
    """(caller, callee, line) of the resolved calls of one file, without the module."""
    spark.conf.set("spark.switchboard.rowsPerTask", request.param)
    _, _, calls = graph_of(spark, {**CLASSES, **CHAINS, **STARS, **TYPES})
    rows = calls.where("callee_id <> '-1'").collect()
    spark.conf.unset("spark.switchboard.rowsPerTask")

    def of_file(path):
        cut = lambda name: name.replace(":<module>", "")
        return {
            (cut(r.caller_full_name).removeprefix(path), cut(r.callee_full_name), r.callsite_line)
            for r in rows
            if r.caller_file == f"/src/{path}"
        }

    return of_file


CLASSES = {
    "lib/core.py": """\
class Base:
    def save(self):
        return self.check()

    def check(self):
        pass

    def save_all(self):
        pass
""",
    "lib/mixed.py": """\
from lib.core import Base

class Left(Base):
    def check(self):
        pass

class Right(Base):
    def save(self):
        pass

    def close(self):
        pass

class Both(Left, Right):
    def run(self):
        self.save()
        self.check()
        self.save_all()
        super().save()
        super().run()

class Loop(Knot):
    def go(self):
        self.tie()

class Knot(Loop):
    def tie(self):
        self.go()
""",
    "app/use.py": """\
import lib.mixed
from lib import mixed as mx
from lib.mixed import Both, Right as R

class Own(mx.Left, object):
    def save(self):
        super().save()
        self.check()

Both.save_all(None)
R.check(None)
mx.Both.close(None)
lib.mixed.Left.save(None)
Own.save_all(None)
""",
    # Decoys, so that no name is the only one of its kind.
    "other/classes.py": "".join(
        f"class D{i}:\n"
        + "".join(f"    def {n}(self):\n        pass\n" for n in "save check save_all close go tie run".split())
        for i in range(2)
    ),
}


def test_inherited_members(calls_of):
    assert calls_of("lib/mixed.py") == {
        (".Both.run", "lib/mixed.py.Right.save", 16),
        (".Both.run", "lib/mixed.py.Left.check", 17),
        (".Both.run", "lib/core.py.Base.save_all", 18),
        (".Both.run", "lib/mixed.py.Right.save", 19),
        # Classes that derive from each other.
        (".Loop.go", "lib/mixed.py.Knot.tie", 24),
        (".Knot.tie", "lib/mixed.py.Loop.go", 28),
    }
    assert calls_of("lib/core.py") == {(".Base.save", "lib/core.py.Base.check", 3)}
    assert calls_of("app/use.py") == {
        (".Own.save", "lib/core.py.Base.save", 7),
        (".Own.save", "lib/mixed.py.Left.check", 8),
        ("", "lib/core.py.Base.save_all", 10),
        ("", "lib/core.py.Base.check", 11),
        ("", "lib/mixed.py.Right.close", 12),
        ("", "lib/core.py.Base.save", 13),
        ("", "lib/core.py.Base.save_all", 14),
    }


CHAINS = {
    "pkg/__init__.py": "from .api import make, Tool as Gadget\nfrom . import deep\nfrom .deep import sub\n",
    "pkg/api.py": "from pkg.impl import build as make\nfrom .impl import Tool\nfrom numpy import array\n",
    "pkg/impl.py": """\
class Tool:
    def use(self):
        pass

def build():
    return Tool()

def hidden():
    from .api import make as local_only
    return local_only()
""",
    "pkg/deep/__init__.py": "from .sub import leaf\n",
    "pkg/deep/sub.py": "def leaf():\n    pass\n",
    # Names that only lead to each other, or out of the corpus.
    "ring/a.py": "from ring.b import spin\n",
    "ring/b.py": "from ring.c import spin\n",
    "ring/c.py": "from ring.a import spin\nfrom pkg.impl import build as spin2\n",
    "use.py": """\
import pkg
from pkg import make, Gadget, deep
from pkg.api import array
from ring.a import spin
from ring.c import spin2
from pkg.deep import leaf as fallen
from pkg.impl import local_only

make()
pkg.make()
Gadget()
pkg.Gadget.use(None)
deep.leaf()
pkg.deep.leaf()
pkg.deep.sub.leaf()
pkg.sub.leaf()
fallen()
spin2()
spin()
array()
local_only()
""",
    "other/decoy.py": "def use():\n    pass\ndef leaf():\n    pass\ndef make():\n    pass\n",
    "other/more.py": "def use():\n    pass\ndef leaf():\n    pass\ndef make():\n    pass\n",
}


def test_names_passed_on(calls_of):
    assert calls_of("use.py") == {
        ("", "pkg/impl.py.build", 9),
        ("", "pkg/impl.py.build", 10),
        ("", "pkg/impl.py.Tool", 11),
        ("", "pkg/impl.py.Tool.use", 12),
        *(("", "pkg/deep/sub.py.leaf", line) for line in (13, 14, 15, 16, 17)),
        ("", "pkg/impl.py.build", 18),
    }


@pytest.mark.parametrize("seed", range(3))
def test_chains_against_a_walk(spark, seed):
    rng = random.Random(seed)
    n = 120
    target = {i: rng.randrange(n + 20) for i in range(n)}  # from n on: definitions
    target.update({i: i + 1 for i in range(60, 95)})  # a long chain
    rows = [
        ("f", f"a{i}", f"s{i}", f"s{t}", f"d{t}" if t >= n else None) for i, t in target.items()
    ]
    rows += [("f", f"x{i}", None, f"s{i}", None) for i in range(0, n, 3)]
    links = spark.createDataFrame(
        rows, "import_path string, alias string, symbol string, target_name string, target_id string"
    )

    def end(i):
        seen = set()
        while i < n and i not in seen:
            seen.add(i)
            i = target[i]
        return i if i >= n else None

    expected = {(f"a{i}", f"d{end(i)}") for i in range(n) if end(i)}
    expected |= {(f"x{i}", f"d{end(i)}") for i in range(0, n, 3) if end(i)}
    found = [(r.alias, r.target_id) for r in follow(links).collect()]
    assert len(found) == len(expected)
    assert set(found) == expected


def test_ancestors_are_in_the_order_python_uses(spark):
    """Random classes; where the order of a class agrees with those of its bases, there is only one
    order, and Python has it too."""
    rng = random.Random(4)
    rows, made, checked = [], {}, 0
    for i in range(60):
        bases = rng.sample(list(made), min(len(made), rng.choice([0, 1, 1, 2, 2, 3])))
        try:
            made[f"c{i}"] = type(f"c{i}", tuple(made[b] for b in bases), {})
        except TypeError:  # no order that Python accepts
            continue
        rows += [(f"c{i}", b, rank) for rank, b in enumerate(bases)]
    found = linearize(spark.createDataFrame(rows, "class string, base string, rank int")).collect()
    places = {}
    for r in found:
        places.setdefault(r["class"], []).append((r.place, r.ancestor))
    assert set(places) == {c for c, _, _ in rows}
    for name, order in places.items():
        expected = [c.__name__ for c in made[name].__mro__[:-1]]
        assert sorted(a for _, a in order) == sorted(expected)
        # The rule of the last place is Python's where no base comes before a class deriving from it.
        if [a for _, a in sorted(order)] == expected:
            checked += 1
    assert checked >= 0.9 * len(places)


def test_classes_that_derive_from_each_other(spark):
    rows = [("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("c", "d", 1), ("e", "a", 0), ("f", "f", 0)]
    found = linearize(spark.createDataFrame(rows, "class string, base string, rank int")).collect()
    above = {}
    for r in sorted(found, key=lambda r: r.place):
        above.setdefault(r["class"], []).append(r.ancestor)
    assert {c: set(a) for c, a in above.items()} == {
        "a": set("abcd"), "b": set("abcd"), "c": set("abcd"), "e": set("eabcd"), "f": {"f"},
    }
    assert above["e"] == list("eabcd")


STARS = {
    "star/one.py": "from star.two import *\ndef shown():\n    pass\ndef _hidden():\n    pass\nfrom numpy import *\n",
    # These two give each other their names.
    "star/two.py": "from star.one import *\ndef both():\n    pass\ndef only_two():\n    pass\nshown()\n",
    "star/listed.py": """\
from .base import *
__all__ = ["_kept", "deep"]
__all__ += ("renamed",)
from .base import plain as renamed
def _kept():
    pass
def not_listed():
    pass
""",
    "star/base.py": "def deep():\n    pass\ndef plain():\n    pass\ndef both():\n    pass\n",
    "star/use.py": """\
from star.two import *
from star.listed import *
from star.base import *
from star.two import shown as again

def plain():
    pass

shown()
only_two()
both()
deep()
_kept()
renamed()
plain()
not_listed()
_hidden()
again()
""",
    # Every name twice, so that none is found by itself.
    **{
        f"other/star{i}.py": "".join(
            f"def {n}():\n    pass\n"
            for n in "shown only_two both deep _kept renamed plain not_listed _hidden again".split()
        )
        for i in range(2)
    },
}


def test_names_given_by_stars(calls_of):
    assert calls_of("star/use.py") == {
        ("", "star/one.py.shown", 9),
        ("", "star/two.py.only_two", 10),
        ("", "star/base.py.both", 11),  # the last star counts
        ("", "star/base.py.deep", 12),
        ("", "star/listed.py._kept", 13),
        ("", "star/base.py.plain", 14),
        ("", "star/use.py.plain", 15),
        ("", "star/one.py.shown", 18),
    }
    assert calls_of("star/two.py") == {("", "star/one.py.shown", 6)}


TYPES = {
    "shop/models.py": """\
class Item:
    def price(self):
        pass

    def twin(self):
        return self

class Car(Item):
    def price(self):
        pass

    def drive(self):
        pass

def pick(flag) -> "Item":
    return find(flag)

def new_car():
    car = Car()
    return car

def either(flag):
    return Item() if flag else new_car()
""",
    "shop/use.py": """\
from shop.models import Car, Item, either, new_car, pick
import shop.models as models

class Stand:
    spare: Car

    def __init__(self, first: Item):
        self.first = first
        self.second = new_car()

    def show(self):
        self.first.price()
        self.second.drive()
        self.spare.drive()

class Booth(Stand):
    def hide(self):
        self.second.price()
        self.show()

def main(gift: models.Car):
    a = Car()
    b = a
    b.drive()
    new_car().drive()
    pick(1).price()
    c = d = models.new_car()
    d.price()
    gift.drive()
    Booth(a).hide()
    Car().twin().price()
    unknown.drive()
    for e in [a]:
        e.drive()

def cycle(x):
    y = x
    x = y
    y = Car()
    x.drive()

class Again:
    def __new__(cls):
        return Item()

def many(flag):
    either(flag).price()
""",
    "other/types.py": "".join(
        f"class D{i}:\n"
        + "".join(f"    def {n}(self):\n        pass\n" for n in "price drive twin show hide".split())
        for i in range(2)
    ),
}


def test_calls_on_objects(calls_of):
    m = "shop/models.py"
    known = ("Car", "Item", "new_car", "pick", "either", "Booth")
    methods = {e for e in calls_of("shop/use.py") if e[1].rsplit(".", 1)[-1] not in known}
    many = {e for e in methods if e[0] == ".many"}
    assert methods - many == {
        (".Stand.show", f"{m}.Item.price", 12),
        (".Stand.show", f"{m}.Car.drive", 13),
        (".Stand.show", f"{m}.Car.drive", 14),
        (".Booth.hide", f"{m}.Car.price", 18),
        (".Booth.hide", "shop/use.py.Stand.show", 19),
        (".main", f"{m}.Car.drive", 24),
        (".main", f"{m}.Car.drive", 25),
        (".main", f"{m}.Item.price", 26),
        (".main", f"{m}.Car.price", 28),
        (".main", f"{m}.Car.drive", 29),
        (".main", "shop/use.py.Booth.hide", 30),
        (".main", f"{m}.Item.twin", 31),
        (".main", f"{m}.Item.price", 31),  # twin returns an Item, as far as is known
        (".cycle", f"{m}.Car.drive", 40),
    }
    # Either class: the export keeps one target of a call.
    either = {(".many", f"{m}.Item.price", 47), (".many", f"{m}.Car.price", 47)}
    assert len(many) == 1 and many < either


def test_methods_that_may_run_instead(spark):
    from test_extract import scratch_path

    from switchboard.operators import extract

    corpus = spark.createDataFrame(list({**CLASSES, **TYPES}.items()), "path string, source string")
    folder = scratch_path(spark, "overriders")
    facts = extract.write_facts(corpus, f"{folder}/facts")
    names = {r.method_id: r.full_name for r in extract.method_nodes(facts).collect()}
    short = lambda i: names[i].split("<module>.")[1]
    overridden = extract.method_overriders(facts)
    assert {(short(r.callee_id), short(r.overrider_id), len(r.place)) for r in overridden.collect()} == {
        ("Base.check", "Left.check", 1),
        ("Base.save", "Own.save", 2),
        ("Base.save", "Right.save", 1),
        ("Item.price", "Car.price", 1),
    }
    ids = {n.split("<module>.")[1]: i for i, n in names.items() if "<module>." in n and "other/" not in n}
    targets = [("c1", 0, ids["Base.save"]), ("c1", 7, ids["Left.check"]), ("c2", 3, ids["Base.check"]),
               ("c3", 1, ids["Car.drive"])]
    calls = spark.createDataFrame(targets, "call_id string, target_ord int, callee_id string")
    found = extract.dispatch_targets(calls, overridden).orderBy("call_id", "target_ord").collect()
    assert [(r.call_id, short(r.callee_id)) for r in found] == [
        ("c1", "Base.save"), ("c1", "Right.save"), ("c1", "Own.save"), ("c2", "Base.check"), ("c2", "Left.check"),
        ("c3", "Car.drive"),
    ]


FAR = {
    "far/__init__.py": "from .a import *\n",
    "far/a.py": "from .b import Top as Renamed\nimport nothing\n",
    "far/b.py": "from .c import Top\n",
    "far/c.py": "class Top:\n    pass\n",
    "far/sub/__init__.py": "",
    "far/sub/leaf.py": "from ..c import Top\nfrom nowhere import f\n",
    "use/one.py": "import far\nclass One(far.Renamed):\n    pass\n",
    "use/two.py": "import far.sub as s\nclass Two(s.leaf.Top):\n    pass\n",
    "use/three.py": "from use import two\nclass Three(two.Two):\n    pass\n",
    "unrelated.py": "from use.one import One as f\nfrom far import *\nf()\n",
}


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_ancestors_follow_from_the_imports_of_bases(spark, monkeypatch, rounds):
    from test_extract import scratch_path

    from switchboard.operators import extract, resolve

    monkeypatch.setattr(resolve, "MAX_ROUNDS", rounds)
    corpus = spark.createDataFrame(list(FAR.items()), "path string, source string")
    facts = extract.write_facts(corpus, f"{scratch_path(spark, 'far')}/facts", extract.NAMING)
    assert not {r.kind for r in facts.collect()} & {"call", "flow"}
    short = lambda name: name.split(".")[-1]
    found = {(short(r["class"]), short(r.ancestor), len(r.place)) for r in extract.ancestors(facts).collect()}
    assert found == {
        *(("One", "One", 0), ("Two", "Two", 0), ("Three", "Three", 0)),
        *(("One", "Top", 1), ("Two", "Top", 1), ("Three", "Two", 1), ("Three", "Top", 2)),
    }
    if rounds == 12:
        imports = facts.where("kind = 'import'")
        kept = resolve._imports_of_bases(
            facts, imports, resolve._last_definitions(extract._definitions(facts))
        )
        assert kept.where("path = 'unrelated.py'").isEmpty()
        assert not kept.where("path = 'far/sub/leaf.py'").isEmpty()


def test_empty_corpus(spark):
    _, methods, calls = graph_of(spark, {})
    assert methods.count() == calls.count() == 0


def test_an_import_is_looked_up_once_per_folder(spark, monkeypatch):
    from test_extract import scratch_path

    from switchboard.operators import extract, resolve

    files = {"lib/__init__.py": "", "lib/a.py": "def f():\n    pass\n"}
    files |= {f"use/u{i}.py": "from lib.a import f\nf()\n" for i in range(20)}
    files["use/in/v.py"] = files["use/in/w.py"] = "from lib.a import f\n"
    corpus = spark.createDataFrame(list(files.items()), "path string, source string")
    facts = extract.write_facts(corpus, scratch_path(spark, "once"))
    store, seen = resolve.stored, {}

    def watched(rows, label):
        seen[label] = store(rows, label)
        return seen[label]

    monkeypatch.setattr(resolve, "stored", watched)
    names = resolve.known_names(facts, extract._definitions(facts), None)
    assert seen["asked-imports"].count() == 2
    links = names.links.where("alias = 'f'").select("import_path", "target_name").collect()
    assert sorted(tuple(r) for r in links) == sorted(
        (path, "lib/a.py:<module>.f") for path in files if path.startswith("use/")
    )
