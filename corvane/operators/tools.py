"""Tools that answer questions without a search."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod, ast.UAdd: operator.pos, ast.USub: operator.neg}
CALCULATED = "struct<status:string,result:double,message:string>"


def calculate(expression: str) -> float:
    """Value of an arithmetic expression; nothing else is evaluated, and powers are bounded."""

    def value(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        if isinstance(node, (ast.BinOp, ast.UnaryOp)) and type(node.op) in OPERATORS:
            parts = [value(node.operand)] if isinstance(node, ast.UnaryOp) else [value(node.left), value(node.right)]
            result = OPERATORS[type(node.op)](*parts)
            if isinstance(result, complex):
                raise ValueError("no real value")
            return result
        raise ValueError("unsupported expression")

    return float(value(ast.parse(expression.strip(), mode="eval").body))


def calculator():
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if not isinstance(text, str) or not text.strip():
                out.append(("error", None, "nothing to calculate"))
                continue
            try:
                out.append(("ok", calculate(text), None))
            except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError) as e:
                out.append(("error", None, type(e).__name__))
        return pd.DataFrame(out, columns=["status", "result", "message"])

    return F.pandas_udf(run, CALCULATED)


def run_select(spark: SparkSession, statement: str) -> DataFrame:
    """Runs one SELECT over registered views; every other statement is refused."""
    text = statement.strip().rstrip(";")
    if ";" in text or not text.lower().startswith(("select", "with")):
        raise ValueError("only a single SELECT is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if any(word in plan.getClass().getName() for word in ("command", "Command", "Insert", "Create", "Drop")):
        raise ValueError("only a single SELECT is allowed")
    return spark.sql(text)


def dispatched(remote_status: Column | str) -> dict[str, Column]:
    """Which tool ran and its status: the remote one, and only where that gave an error the local one."""
    status = F.col(remote_status) if isinstance(remote_status, str) else remote_status
    failed = status == "error"
    return {"ran": F.when(failed, "local").otherwise("remote"), "status": F.when(failed, "ok").otherwise(status)}


def summary(result: Column | str, most: int = 400) -> Column:
    """A result cut to ``most`` characters."""
    return F.substring(result, 1, most)


#: Tools by name with the inputs they take.
REGISTRY = {"calculator": ["expression"], "sql_executor": ["sql"], "api_caller": ["url", "method"], "code_runner": ["snippet"]}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in REGISTRY.items()], "tool string, inputs array<string>")
