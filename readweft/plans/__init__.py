from .catalog import QUERIES, SQL
from .derive import READS_SQL, reads_of

__all__ = ["QUERIES", "READS_SQL", "SQL", "reads_of"]
