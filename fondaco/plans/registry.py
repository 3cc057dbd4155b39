"""All queries of the core, with the SQL that checks them."""

from . import candidates, derived, intake, linkage, person_links, recognition, reference_checks, reports, rules, store, streams, text

_MODULES = [reference_checks, store, text, recognition, rules, streams, linkage, derived, person_links, intake, reports, candidates]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
