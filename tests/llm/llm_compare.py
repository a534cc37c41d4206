"""A query of the training-data part beside its SQL."""

from compare import _TYPE_NAMES, normalised, oracle_connection

from silverbrook.llm.queries import ORACLES, QUERIES


def agree(spark, folder, name):
    df = QUERIES[name](spark, folder)
    result = oracle_connection(folder).execute(ORACLES[name])
    names, types = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    assert normalised(df.columns, df.collect()) == normalised(names, result.fetchall())
    assert {f.name: _TYPE_NAMES[f.dataType.simpleString()] for f in df.schema.fields} == types
