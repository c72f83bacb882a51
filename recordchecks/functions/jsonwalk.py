"""Scalars of a nested value at any depth, as one fold over its JSON tokens.

Nothing is unrolled by level: the fold carries the open containers as an array,
so the plan has one size whatever the data nests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64
TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^"{}\[\]:,\s]+'
_NODE = "array<struct<path:string,top:string,idx:int,leaf:string,v:variant>>"
_FRAMES = "array<struct<obj:boolean,path:string,top:string,idx:int,leaf:string,i:int>>"


def _index(path: Column, idx: Column, i: Column) -> Column:
    """Index inside a first-level array: that of the first array on the way."""
    return F.when(idx.isNull() & ~path.contains("["), i).otherwise(idx)


def scalars_below(v: Column, path: Column, top: Column, idx: Column, leaf: Column, norm) -> Column:
    """Array of (path, top, idx, leaf, v) of the scalars in the variant ``v`` that stands
    at ``path``; keys pass through ``norm``; containers without scalars give nothing."""
    def state(frames, path, top, idx, leaf, key) -> Column:
        return F.struct(frames.alias("frames"), path.alias("path"), top.alias("top"), idx.cast("int").alias("idx"),
                        leaf.alias("leaf"), key.alias("key"))

    def step(s: Column, t: Column) -> Column:
        last = F.get(s["frames"], F.size(s["frames"]) - 1)
        outer = F.slice(s["frames"], F.lit(1), F.greatest(F.size(s["frames"]) - 1, F.lit(0)))

        def frame(obj: bool, i) -> Column:
            return F.struct(F.lit(obj).alias("obj"), s["path"].alias("path"), s["top"].alias("top"), s["idx"].alias("idx"),
                            s["leaf"].alias("leaf"), F.lit(i).cast("int").alias("i"))

        nth = last["i"] + 1
        moved = F.struct(last["obj"].alias("obj"), last["path"].alias("path"), last["top"].alias("top"), last["idx"].alias("idx"),
                         last["leaf"].alias("leaf"), nth.alias("i"))
        name = norm(F.try_variant_get(F.try_parse_json(t), "$", "string"))
        keyed = F.when(last["path"] == "", name).otherwise(F.concat(last["path"], F.lit("."), name))
        no, yes = F.lit(False), F.lit(True)
        return (F.when(t == "{", state(F.concat(s["frames"], F.array(frame(True, 0))), s["path"], s["top"], s["idx"], s["leaf"], yes))
                .when(t == "[", state(F.concat(s["frames"], F.array(frame(False, 0))), F.concat(s["path"], F.lit("[0]")), s["top"],
                                      _index(s["path"], s["idx"], F.lit(0)), s["leaf"], no))
                .when((t == "}") | (t == "]"), state(outer, s["path"], s["top"], s["idx"], s["leaf"], no))
                .when((t == ",") & last["obj"], state(s["frames"], s["path"], s["top"], s["idx"], s["leaf"], yes))
                .when(t == ",", state(F.concat(outer, F.array(moved)), F.concat(last["path"], F.lit("["), nth.cast("string"), F.lit("]")),
                                      last["top"], _index(last["path"], last["idx"], nth), last["leaf"], no))
                .when(t == ":", state(s["frames"], s["path"], s["top"], s["idx"], s["leaf"], no))
                .when(s["key"], state(s["frames"], keyed, F.coalesce(last["top"], name), last["idx"], name, no))
                .otherwise(s))

    def take(a: Column, t: Column) -> Column:
        s = a["now"]
        here = F.struct(s["path"].alias("path"), s["top"].alias("top"), s["idx"].alias("idx"), s["leaf"].alias("leaf"),
                        F.try_parse_json(t).alias("v"))
        value = ~t.isin("{", "}", "[", "]", ":", ",") & ~s["key"]
        return F.struct(step(s, t).alias("now"), F.when(value, F.concat(a["out"], F.array(here))).otherwise(a["out"]).alias("out"))

    def walk(tokens: Column) -> Column:
        first = state(F.array().cast(_FRAMES), path, top, idx, leaf, F.lit(False))

        def chunk(k: Column) -> Column:
            return F.slice(tokens, k * CHUNK + 1, CHUNK)

        # the state before each chunk, then each chunk on its own: no array is copied once a token
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(tokens) - 1, F.lit(0)) / CHUNK).cast("int"))
        start = F.struct(first.alias("now"), F.filter(F.array(first), lambda _: F.lit(False)).alias("out"))
        states = F.aggregate(numbers, start, lambda a, k: F.struct(
            F.aggregate(chunk(k), a["now"], step).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")))["out"]
        none = F.array().cast(_NODE)
        return F.flatten(F.zip_with(numbers, states, lambda k, s: F.aggregate(
            chunk(k), F.struct(s.alias("now"), none.alias("out")), take)["out"]))

    tokens = F.regexp_extract_all(F.to_json(v), F.lit(TOKEN), F.lit(0))
    return F.get(F.transform(F.array(tokens), walk), F.lit(0))
