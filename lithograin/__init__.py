"""lithograin: a Spark-native engine for typed tables, filters, joins, aggregates and SQL text."""

from .config import Settings
from .database import Database
from .functions.aggregates import Aggregate, avg_of, count, count_column, max_of, min_of, sum_of
from .functions.predicates import Filter, Operator
from .operators.joins import JoinChain
from .plans.builder import QueryBuilder

__version__ = "0.1.0"
__all__ = ["Aggregate", "Database", "Filter", "JoinChain", "Operator", "QueryBuilder", "Settings", "avg_of", "count", "count_column", "max_of", "min_of", "sum_of"]
