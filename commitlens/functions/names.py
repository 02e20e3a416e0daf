"""Names of commits as bytes, for rows that are shuffled."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(name: Column) -> Column:
    """A name in half its bytes if it is lower-case hex, else with one byte more; equal for equal names only."""
    data = F.unhex(name)
    return F.when(F.lower(F.hex(data)) == name, F.concat(F.unhex(F.lit("00")), data)).otherwise(
        F.concat(F.unhex(F.lit("01")), F.encode(name, "UTF-8"))
    )


def unpacked(data: Column) -> Column:
    """The name that ``packed`` was given."""
    rest = F.substring(data, 2, 2**31 - 1)
    return F.when(F.hex(F.substring(data, 1, 1)) == "00", F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
