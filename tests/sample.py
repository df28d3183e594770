"""A small catalogue in the raw line format, written for these tests."""

import json

RAW_PRODUCTS = [
    {"parent_asin": "P1", "title": "Aurora Wireless Headphones", "features": ["noise cancelling", None, "bluetooth"],
     "description": ["Comfortable over-ear headphones"], "categories": ["Audio", "Headphones"], "store": "Aurora",
     "price": "$249.00", "average_rating": 4.5, "rating_number": 1200, "details": {"Brand": "Other"}},
    {"product_id": "P2", "title": "Cable", "features": [], "description": [], "main_category": "Accessories",
     "details": {"Zeta": "z", "Brand": "", "Manufacturer": "Wirely"}, "price": "from $1,299.50", "average_rating": 0, "rating": 4.5},
    {"asin": "P3", "title": "Keyboard", "features": {"x": "p", "a": "q"}, "price": None, "rating": "0", "average_rating": "0",
     "rating_number": "1,024 ratings", "category": "Input", "brand": "Keys"},
    {"parent_asin": "P4", "title": "", "price": 5},
    {"title": "No identifier"},
    {"parent_asin": "P5", "title": "Negative", "price": -5, "categories": [], "main_category": "M"},
    {"parent_asin": "P6", "title": "Negative text", "price": "-5", "features": [["deep", {"z": "er", "k": True}], 1, 2.5]},
    {"parent_asin": "P1", "title": "Aurora Wireless Headphones II", "store": "Aurora", "price": "none"},
]

RAW_REVIEWS = [
    {"parent_asin": "P1", "user_id": "u1", "rating": 5.0, "title": "Fine", "text": "", "timestamp": 1700000000, "helpful_vote": 3,
     "verified_purchase": None},
    *[
        {"asin": "P1", "reviewerID": f"r{i}", "overall": 1 + i % 5, "summary": "s", "reviewText": f"text {i}", "text": "",
         "timestamp": str(123 + i), "helpful_vote": "2", "verified_purchase": "Yes"}
        for i in range(6)
    ],
    {"asin": "P2", "user_id": "u2", "rating": 2, "title": "Breaks", "text": "The cable's end breaks", "timestamp": 1700000000.5,
     "verified": True},
    {"product_id": "P3", "rating": 4, "title": "Good", "text": "Types well", "timestamp": -1, "verified_purchase": 0},
    {"parent_asin": "P9", "rating": 4, "title": "Unknown product", "text": "x"},
    {"rating": 4, "title": "No product", "text": "x"},
]


def lines(rows, blank=False):
    text = [json.dumps(r) for r in rows]
    return [t for pair in zip(text, ["   "] * len(text)) for t in pair] if blank else text
