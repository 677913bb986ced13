"""Company filings: sectors of industry codes, names that match across sources, identifiers inside identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Industry codes from, to, and their sector.
SIC_SECTORS = (
    (100, 999, "Consumer Staples"), (1000, 1299, "Materials"), (1300, 1399, "Energy"), (1400, 1499, "Materials"), (1500, 1799, "Industrials"), (2000, 2199, "Consumer Staples"),
    (2200, 2399, "Consumer Discretionary"), (2400, 2799, "Materials"), (2800, 2829, "Materials"), (2830, 2836, "Health Care"), (2840, 2844, "Consumer Staples"), (2845, 2899, "Materials"),
    (2900, 2999, "Energy"), (3000, 3569, "Industrials"), (3570, 3579, "Technology"), (3580, 3659, "Industrials"), (3660, 3699, "Technology"), (3700, 3715, "Consumer Discretionary"),
    (3716, 3799, "Industrials"), (3800, 3829, "Industrials"), (3840, 3851, "Health Care"), (3852, 3999, "Consumer Discretionary"), (4000, 4799, "Industrials"),
    (4800, 4899, "Communication Services"), (4900, 4999, "Utilities"), (5000, 5199, "Industrials"), (5200, 5399, "Consumer Discretionary"), (5400, 5499, "Consumer Staples"),
    (5500, 5999, "Consumer Discretionary"), (6000, 6499, "Financials"), (6500, 6553, "Real Estate"), (6770, 6797, "Financials"), (6798, 6798, "Real Estate"), (6799, 6799, "Financials"),
    (7000, 7369, "Consumer Discretionary"), (7370, 7379, "Technology"), (7380, 7999, "Industrials"), (8000, 8099, "Health Care"), (8100, 8999, "Industrials"),
)
#: Words of a company's name that sources write or leave out.
NAME_NOISE = ("inc", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "the", "sa", "nv", "ag", "se", "class", "cl", "a", "b", "c", "holdings", "holding", "group", "adr", "com", "new", "del")


def sic_sector(sic: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, sector in SIC_SECTORS:
        out = F.when(sic.between(low, high), sector).otherwise(out)
    return out


def normalised_company(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*NAME_NOISE)), " ")


def cusip(isin: Column) -> Column:
    """The CUSIP in a US or Canadian ISIN."""
    return F.when((F.length(isin) == 12) & F.left(isin, F.lit(2)).isin("US", "CA"), F.substring(isin, 3, 9))
