"""Registered queries: importing this package imports every module that has some."""

from tokenloom.plans import arabic, english, evaluation, facade, generation, logic, parsed, sources, vocabulary  # noqa: F401
from tokenloom.plans import registry

for _name, _other in facade.SAME.items():
    registry.QUERIES[_name] = registry.QUERIES[_other]
    if _other in registry.ORACLE_SQL:
        registry.ORACLE_SQL[_name] = registry.ORACLE_SQL[_other]
