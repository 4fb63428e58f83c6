"""Which columns go through a pass over texts."""

from pyspark.sql import DataFrame, functions as F


def free_name(name: str, columns: list[str]) -> str:
    """The name with as many underscores after it as it takes to be no column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(docs: DataFrame, keep: list[str], text: str, added: list[str]) -> tuple[DataFrame, str, str]:
    """(the kept columns with the text, the text's name there, schema of the kept columns).

    A text that is kept is sent once. Names that the pass adds may not be among the kept ones.
    """
    clash = sorted({c.lower() for c in keep} & {c.lower() for c in added})
    if clash:
        raise ValueError(f"columns {clash} would be overwritten; leave them out of those kept")
    name = text if text in keep else free_name("__text", keep)
    base = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(name))
    return base, name, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema if f.name in keep)
