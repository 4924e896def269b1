"""Graph sources: triples (s, p, o, datatype) as class tables, with property profiles and cardinality hints."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import PlanError

from tessella.operators.windows import checkpointed

from .retrieval import retrieve

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
_INTEGERS = {"integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong"}
_FLOATS = {"decimal", "double", "float"}


def typed(value: Column, datatype: str | None) -> Column:
    """A literal as its declared XSD type; references and unknown types stay text."""
    name = (datatype or "").removeprefix(XSD)
    if name in _INTEGERS:
        return value.try_cast("long")
    if name in _FLOATS:
        return value.try_cast("double")
    if name == "boolean":
        return F.when(value.isin("true", "1"), True).when(value.isin("false", "0"), False)
    if name == "date":
        return value.try_cast("date")
    return value.try_cast("timestamp").cast("timestamp_ntz") if name in ("dateTime", "dateTimeStamp") else value


def class_table(triples: DataFrame, class_iri: str, properties: dict[str, dict[str, Any]], subject: str = "subject_iri", optional: tuple[str, ...] = ()) -> DataFrame:
    """A row for each instance and combination of its properties' values: required properties must be there, optional ones
    may be null, and several values of one property give several rows. properties: field -> {iri, datatype, same_as, single}.

    Properties declared `single` (see property_profile) are pivoted in one pass over the triples, and a second value of one
    is an error; each other property is a join on the subject, which keeps the pass's partitioning.
    """
    iris = {name: [spec["iri"], *spec.get("same_as", [])] for name, spec in properties.items()}
    single = [name for name, spec in properties.items() if spec.get("single")]
    read = sorted({i for name in single for i in iris[name]})
    is_member = (F.col("p") == TYPE) & (F.col("o") == class_iri)
    of = lambda name: F.when(F.col("p").isin(*iris[name]), F.col("o"))
    ends = [f(of(name)).alias(f"__{end}{i}") for i, name in enumerate(single) for end, f in (("low", F.min), ("high", F.max))]
    rows = triples.where(is_member | F.col("p").isin(*read) if read else is_member).groupBy(F.col("s").alias(subject))
    rows = rows.agg(F.max(is_member).alias("__member"), *ends).where("__member")
    for i, name in enumerate(single):
        several = F.raise_error(F.concat(F.lit(f"several values of {name}: "), F.col(subject))).cast("string")
        rows = rows.withColumn(f"__value{i}", F.when(F.col(f"__low{i}") != F.col(f"__high{i}"), several).otherwise(F.col(f"__low{i}")))
        rows = rows if name in optional else rows.where(F.col(f"__value{i}").isNotNull())
    out = rows.select(subject, *[typed(F.col(f"__value{i}"), properties[name].get("datatype")).alias(name) for i, name in enumerate(single)])
    for name in [n for n in properties if n not in single]:
        values = triples.where(F.col("p").isin(*iris[name])).select(F.col("s").alias(subject), typed(F.col("o"), properties[name].get("datatype")).alias(name))
        if len(iris[name]) > 1:  # equivalent properties may state one fact twice
            values = values.distinct()
        out = out.join(values, subject, "left" if name in optional else "inner")
    return out.select(subject, *properties)


#: Ontology terms.
OWL, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
CLASSES, SAME = (OWL + "Class", RDFS + "Class"), OWL + "equivalentProperty"


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^/#]*)[/#]?$", 1)


def describe(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Rows (class, class_iri, instances, field, property_iri, datatype, targets, same_as): what populated classes offer.

    A class counts if the ontology declares it and the triples hold instances of it; its properties are those that its
    instances have. `datatype` is number, boolean, text or reference; `targets` lists the classes that references point to,
    `same_as` the properties that the ontology calls equivalent. A property of both literals and references is an error.
    """
    declared = ontology.where((F.col("p") == TYPE) & F.col("o").isin(*CLASSES)).select(F.col("s").alias("class_iri")).distinct()
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("class_iri")).distinct()
    known = types.join(F.broadcast(declared), "class_iri")
    sizes = known.groupBy("class_iri").agg(F.count(F.lit(1)).alias("instances"))
    facts = known.join(triples.where(F.col("p") != TYPE), "s").select("class_iri", F.col("p").alias("property_iri"), "o", "datatype")
    target = facts.join(types.select(F.col("s").alias("o"), F.col("class_iri").alias("target")), "o", "left")
    short = F.regexp_replace("datatype", "^" + XSD, "")
    number, literal = short.isin(*_INTEGERS, *_FLOATS), F.col("datatype").isNotNull() & F.col("target").isNull()
    every = lambda c: F.min(F.coalesce(c, F.lit(False)).cast("int")) == 1
    some = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    shape = target.groupBy("class_iri", "property_iri").agg(
        every(number).alias("number"), every(short == "boolean").alias("boolean"), some(literal).alias("literal"),
        some(F.col("target").isNotNull()).alias("reference"), F.array_join(F.array_sort(F.collect_set(local_name(F.col("target")))), ",").alias("targets"),
    )
    mixed = F.raise_error(F.concat(F.lit("a property of both literals and references: "), F.col("property_iri"))).cast("string")
    kind = F.when(F.col("reference") & F.col("literal"), mixed).when(F.col("reference"), "reference").when(F.col("number"), "number").when(F.col("boolean"), "boolean").otherwise("text")
    pairs = ontology.where(F.col("p") == SAME).select(F.col("s").alias("property_iri"), F.col("o").alias("other"))
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("property_iri"), F.col("property_iri").alias("other")))
    same = pairs.groupBy("property_iri").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("same_as"))
    named = shape.join(sizes, "class_iri").join(F.broadcast(same), "property_iri", "left")
    return named.select(local_name(F.col("class_iri")).alias("class"), "class_iri", "instances", local_name(F.col("property_iri")).alias("field"), "property_iri", kind.alias("datatype"), "targets", F.coalesce("same_as", F.lit("")).alias("same_as"))


def as_classes(described: DataFrame) -> dict[str, dict[str, Any]]:
    """describe()'s rows, one for each property of the ontology, as the classes that retrieve_class reads."""
    types, out = {"number": XSD + "double", "boolean": XSD + "boolean"}, {}
    for r in described.collect():
        found = out.setdefault(r["class"], {"iri": r.class_iri, "properties": {}})
        if r.field in found["properties"] or r.class_iri != found["iri"]:
            raise PlanError(f"ambiguous name: {r['class']}.{r.field}")
        found["properties"][r.field] = {"iri": r.property_iri, "datatype": types.get(r.datatype), "same_as": [x for x in r.same_as.split(",") if x]}
    return out


def retrieve_class(triples: DataFrame, contract: dict[str, Any], classes: dict[str, dict]) -> DataFrame:
    """The raw retrieval contract over a class; filters apply after optional properties are attached."""
    known = classes.get(contract.get("class"))
    if not known:
        raise PlanError(f"unknown class: {contract.get('class')}")
    subject, optional = known.get("subject", "subject_iri"), tuple(contract.get("optional_fields") or ())
    fields = contract.get("fields") or []
    if set(optional) - set(fields):
        raise PlanError("optional fields must be selected")
    unknown = [f for f in fields if f != subject and f not in known["properties"]]
    if unknown:
        raise PlanError([f"unknown property: {f}" for f in unknown])
    df = class_table(triples, known["iri"], {f: known["properties"][f] for f in fields if f != subject}, subject, optional)
    return retrieve({**contract, "optional_fields": None}, df)


#: Triples of a task of property_profile on average.
ROWS_PER_TASK = 200_000


def property_profile(triples: DataFrame) -> DataFrame:
    """Per class and property: instances that have it, values, distinct values, datatypes, most subjects that share a value."""
    # dealt by subject to a number of tasks that grows with the triples; all but the last counts stay within these tasks
    tasks = max(1, -(-triples.count() // ROWS_PER_TASK))
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("class")).repartition(tasks, "s")
    facts = types.join(triples.where(F.col("p") != TYPE).repartition(tasks, "s"), "s")
    by_subject = facts.groupBy("class", "p", "o", "s").agg(F.count(F.lit(1)).alias("n"))
    by_value = by_subject.groupBy("class", "p", "o").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("subjects"))
    values = by_value.groupBy("class", "p").agg(F.sum("n").alias("values"), F.count(F.lit(1)).alias("distinct"), F.max("subjects").alias("most_subjects"))
    instances = facts.groupBy("class", "p", "s").agg(F.lit(1)).groupBy("class", "p").agg(F.count(F.lit(1)).alias("instances"))
    datatypes = facts.groupBy("class", "p", "datatype").agg(F.lit(1)).groupBy("class", "p").agg(F.array_sort(F.collect_set("datatype")).alias("datatypes"))
    owners = instances.join(datatypes, ["class", "p"])
    sizes = types.groupBy("class").agg(F.count_distinct("s").alias("members"))
    return values.join(owners, ["class", "p"]).join(sizes, "class").withColumns({"coverage": F.col("instances") / F.col("members"), "distinct_ratio": F.col("distinct") / F.col("values")})


def links(triples: DataFrame, path: list[str]) -> DataFrame:
    """Pairs (start, end) along a path of object properties."""
    steps = [triples.where(F.col("p") == iri).select(F.col("s").alias(f"n{i}"), F.col("o").alias(f"n{i + 1}")) for i, iri in enumerate(path)]
    joined = reduce(lambda a, b: a.join(b, b.columns[0]), steps)
    return joined.select(F.col("n0").alias("start"), F.col(f"n{len(path)}").alias("end"))


def hops(edges: DataFrame) -> DataFrame:
    """Longest of the shortest paths in each graph of edges(graph, a, b): breadth-first by self joins, all starts at once.

    It runs until no start reaches a new node. A neighbour lies at most one step nearer or farther, so what a round
    reaches is compared with the last two frontiers only.
    """
    both = edges.select(F.col("graph").alias("g"), F.col("a").alias("from"), F.col("b").alias("to"))
    both = checkpointed(both.union(both.select("g", "to", "from")).distinct())
    frontier = checkpointed(both.select(F.col("g").alias("graph"), F.col("from").alias("start"), F.col("from").alias("node")).distinct())
    before, found, depth = frontier.limit(0), frontier.select("graph", F.lit(0).alias("d")).distinct(), 0
    while not frontier.isEmpty():
        depths = frontier.select("graph", F.lit(depth).alias("d")).distinct()
        found = checkpointed(found.unionByName(depths).groupBy("graph").agg(F.max("d").alias("d")))
        reached = frontier.join(both, (F.col("graph") == F.col("g")) & (F.col("node") == F.col("from"))).select("graph", "start", F.col("to").alias("node")).distinct()
        before, frontier = frontier, checkpointed(reached.join(before.unionByName(frontier), ["graph", "start", "node"], "left_anti"))
        depth += 1
    return found.select("graph", F.col("d").cast("long").alias("hops"))
