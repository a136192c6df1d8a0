"""Read a DataFrame's physical plan in tests."""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
