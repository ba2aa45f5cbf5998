"""Vendor and industry codes, as small tables to look up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The vendor's codes of exchanges.
EXCHANGES = {11: "NYSE", 12: "AMEX", 14: "NASDAQ", 15: "NYSE MKT", 19: "OTC", 90: "TSX", 91: "LSE"}
# The vendor's codes of why a company was deleted.
DELISTINGS = {
    "01": "Dropped — no longer fits S&P's coverage criteria",
    "02": "Fiscal year change",
    "03": "Bankruptcy",
    "04": "Reverse acquisition",
    "06": "Acquisition / merger",
    "07": "Leveraged buyout",
    "08": "Private",
    "09": "Foreign incorporation",
    "10": "Delisted / insufficient SEC filings",
    "11": "Reverse merger",
}
# The major groups of the industry classification by their two digits.
DIVISIONS = {
    "01": "Crops", "02": "Livestock", "07": "Agricultural Services", "08": "Forestry", "09": "Fishing",
    "10": "Metal Mining", "11": "Anthracite Mining", "12": "Coal Mining", "13": "Oil & Gas Extraction", "14": "Non-Metallic Minerals",
    "15": "Building Construction", "16": "Heavy Construction", "17": "Special Trade Contractors",
    "20": "Food Products", "21": "Tobacco", "22": "Textile Mill Products", "23": "Apparel", "24": "Lumber & Wood", "25": "Furniture",
    "26": "Paper", "27": "Printing & Publishing", "28": "Chemicals", "29": "Petroleum Refining", "30": "Rubber & Plastics", "31": "Leather",
    "32": "Stone, Clay, Glass", "33": "Primary Metals", "34": "Fabricated Metals", "35": "Industrial Machinery", "36": "Electronic Equipment",
    "37": "Transportation Equipment", "38": "Instruments", "39": "Misc Manufacturing",
    "40": "Railroads", "41": "Local Transit", "42": "Trucking", "44": "Water Transportation", "45": "Air Transportation", "46": "Pipelines",
    "47": "Transportation Services", "48": "Communications", "49": "Electric, Gas, Sanitary Services",
    "50": "Durable Goods Wholesale", "51": "Non-Durable Goods Wholesale", "52": "Building Materials Retail", "53": "General Merchandise",
    "54": "Food Stores", "55": "Auto Dealers", "56": "Apparel Stores", "57": "Furniture Stores", "58": "Eating & Drinking Places", "59": "Misc Retail",
    "60": "Depository Institutions", "61": "Non-Depository Credit", "62": "Security & Commodity Services", "63": "Insurance Carriers",
    "64": "Insurance Agents", "65": "Real Estate", "67": "Holding & Investment Companies",
    "70": "Hotels & Lodging", "72": "Personal Services", "73": "Computer & Data Processing", "75": "Auto Repair", "76": "Misc Repair",
    "78": "Motion Pictures", "79": "Amusement & Recreation", "80": "Health Services", "82": "Educational Services", "83": "Social Services",
    "86": "Membership Organizations", "87": "Engineering & Management", "89": "Misc Services",
    "91": "Federal Government", "92": "State Government", "93": "Finance, Taxation, Monetary Policy", "94": "Administration of Human Resources",
    "95": "Environmental Quality", "96": "Administration of Economic Programs", "97": "National Security", "99": "Nonclassifiable Establishments",
}


def _named(code: Column, names: dict, default: str | None) -> Column:
    found = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[code]
    return F.coalesce(found, F.lit(default)) if default else found


def exchange_name(code: Column) -> Column:
    """"Other" for codes that are missing, not numbers or not listed."""
    return _named(code.try_cast("double").try_cast("int"), EXCHANGES, "Other")


def delist_reason(code: Column) -> Column:
    return _named(F.trim(code.cast("string")), DELISTINGS, "Unknown")


def sic_division(sic: Column) -> Column:
    """By the first two of four digits; NULL where they aren't listed."""
    return _named(F.substring(sic, 1, 2), DIVISIONS, None)
