"""Plans and expressions as Spark's own parser gives them: walked, rewritten, and turned into DataFrames and Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

_KINDS = {
    "node": "org.apache.spark.sql.catalyst.trees.TreeNode", "plan": "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "subquery": "org.apache.spark.sql.catalyst.expressions.PlanExpression",
    "seq": "scala.collection.Seq", "some": "scala.Some", "pair": "scala.Tuple2", "triple": "scala.Tuple3",
}


def plain(value):
    """A parameter as Python's or Spark's own type."""
    if isinstance(value, pd.Timestamp):
        return str(value)
    return value.item() if isinstance(value, np.generic) else bytes(value) if isinstance(value, (bytearray, memoryview)) else value


class Catalyst:
    """Spark's parser and analyzer of a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self._session = spark, spark._jvm, spark._jsparkSession
        self._parser = self._session.sessionState().sqlParser()
        self._classes = {kind: self.jvm.java.lang.Class.forName(name) for kind, name in _KINDS.items()}

    def parse(self, text: str) -> JavaObject:
        return self._parser.parsePlan(text)

    def parse_expression(self, text: str) -> JavaObject:
        return self._parser.parseExpression(text)

    def is_(self, kind: str, x) -> bool:
        return isinstance(x, JavaObject) and self._classes[kind].isInstance(x)

    @staticmethod
    def name(node: JavaObject) -> str:
        return node.getClass().getSimpleName()

    def items(self, seq: JavaObject) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def seq(self, items: Sequence) -> JavaObject:
        return self.jvm.PythonUtils.toSeq(list(items))

    def column(self, expression: JavaObject) -> Column:
        return ClassicColumn(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def expression(self, column: Column) -> JavaObject:
        return self._session.expression(column._jc)

    def frame(self, plan: JavaObject) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self._session, plan), self.spark)

    def relation(self, name: str, df: DataFrame) -> JavaObject:
        """A plan that stands for df under a name."""
        return df.alias(name)._jdf.queryExecution().logical()

    def place(self, node: JavaObject) -> tuple[str, int, int] | None:
        """Where in its text a node was read, which analysis keeps."""
        start, stop = node.origin().startIndex(), node.origin().stopIndex()
        return (self.name(node), start.get(), stop.get()) if start.isDefined() and stop.isDefined() else None

    def rewrite(self, node: JavaObject, change: Callable[[JavaObject], JavaObject]) -> JavaObject:
        """The tree with each node, from the leaves up, as `change` gives it; subqueries' plans too."""
        if self.is_("plan", node):
            args = [node.productElement(i) for i in range(node.productArity())]
            made = [self._changed(x, change) for x in args]
            if any(a is not b for a, b in zip(args, made)):
                array = self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.Object, len(made))
                for i, x in enumerate(made):
                    array[i] = x
                node = node.makeCopy(array)
            return change(node)
        children = self.items(node.children())
        made = [self.rewrite(x, change) for x in children]
        if any(a is not b for a, b in zip(children, made)):
            node = node.withNewChildren(self.seq(made))
        if self.is_("subquery", node):
            plan = node.plan()
            if (new := self.rewrite(plan, change)) is not plan:
                node = node.withNewPlan(new)
        return change(node)

    def _changed(self, x, change):
        if self.is_("node", x):
            return self.rewrite(x, change)
        if self.is_("seq", x):
            items = self.items(x)
            made = [self._changed(i, change) for i in items]
            return self.seq(made) if any(a is not b for a, b in zip(items, made)) else x
        if self.is_("some", x):
            inner = x.get()
            made = self._changed(inner, change)
            return x if made is inner else self.jvm.scala.Some(made)
        if self.is_("pair", x) or self.is_("triple", x):
            parts = [x.productElement(i) for i in range(x.productArity())]
            made = [self._changed(p, change) for p in parts]
            if any(a is not b for a, b in zip(parts, made)):
                return (self.jvm.scala.Tuple2 if len(made) == 2 else self.jvm.scala.Tuple3)(*made)
        return x

    def walk(self, node: JavaObject) -> Iterator[JavaObject]:
        """All nodes of a tree, plans and expressions and those of subqueries."""
        yield node
        if self.is_("plan", node):
            for i in range(node.productArity()):
                yield from self._within(node.productElement(i))
        else:
            for child in self.items(node.children()):
                yield from self.walk(child)
            if self.is_("subquery", node):
                yield from self.walk(node.plan())

    def _within(self, x) -> Iterator[JavaObject]:
        if self.is_("node", x):
            yield from self.walk(x)
        elif self.is_("seq", x):
            for i in self.items(x):
                yield from self._within(i)
        elif self.is_("some", x):
            yield from self._within(x.get())
        elif self.is_("pair", x) or self.is_("triple", x):
            for i in range(x.productArity()):
                yield from self._within(x.productElement(i))

    def parameters(self, node: JavaObject) -> dict[int, int]:
        """The order of `?` parameters by their place in the text."""
        places = sorted(n.pos() for n in self.walk(node) if self.name(n) == "PosParameter")
        return {place: i for i, place in enumerate(places)}

    def bind(self, node: JavaObject, values: Sequence | dict) -> JavaObject:
        """The tree with literals, or Columns, in the place of its `?` or `:name` parameters."""
        order = self.parameters(node)
        if not isinstance(values, dict) and len(values) != len(order):
            raise ValueError(f"{len(order)} parameters are asked for, {len(values)} given")
        made = lambda v: self.expression(v if isinstance(v, Column) else F.lit(plain(v)))

        def change(n: JavaObject) -> JavaObject:
            kind = self.name(n)
            if kind == "PosParameter" and not isinstance(values, dict):
                return made(values[order[n.pos()]])
            if kind == "NamedParameter":
                if not isinstance(values, dict) or n.name() not in values:
                    raise ValueError(f"no value for :{n.name()}")
                return made(values[n.name()])
            return n

        return self.rewrite(node, change)

    def conjuncts(self, expression: JavaObject) -> list[JavaObject]:
        if self.name(expression) == "And":
            return self.conjuncts(expression.left()) + self.conjuncts(expression.right())
        return [expression]

    def attributes(self, node: JavaObject) -> list[list[str]]:
        """The names, in their parts, of all columns that a tree mentions."""
        return [self.items(n.nameParts()) for n in self.walk(node) if self.name(n) == "UnresolvedAttribute"]
