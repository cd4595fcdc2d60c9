"""Named queries over the test tables and their SQL, one module per family."""

from loomwork.queries import data, further, more, pages, rest, scalars, tables

QUERIES = {**data.QUERIES, **scalars.QUERIES, **tables.QUERIES, **pages.QUERIES, **more.QUERIES, **rest.QUERIES, **further.QUERIES}
ORACLES = {**data.ORACLES, **scalars.ORACLES, **tables.ORACLES, **pages.ORACLES, **more.ORACLES, **rest.ORACLES, **further.ORACLES}
