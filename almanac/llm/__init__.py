"""Operations of a training-data pipeline (tokenising, dedup, search, filtering, mixing, sharding).

Nothing outside this folder imports it. Each module holds one operator with a general interface;
:mod:`almanac.llm.queries` applies them to the tables."""
