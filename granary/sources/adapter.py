"""Domain adapters: the built-in one for groceries, those shipped as files, and any file of a deployment."""

from __future__ import annotations

from importlib.resources import files

from granary.functions.vocab import RETAIL, Adapter

#: Keys of a file and the adapter's fields. Units of a domain are what its aliases stand for unless it lists them.
KEYS = {
    "brand_aliases": "brand_aliases", "dietary_tag_aliases": "tag_aliases", "allergen_aliases": "allergen_aliases", "unit_aliases": "unit_aliases",
    "ingredient_aliases": "ingredient_aliases", "dosage_form_aliases": "dosage_form_aliases", "dietary_tags_controlled": "tags",
    "allergens_controlled": "allergens", "units": "units", "categories": "categories", "category_keywords": "category_keywords",
    "valid_hazmat_classes": "hazmat_classes", "valid_schedule_classes": "schedule_classes", "compliance_fields": "compliance_fields",
}


def parse(text: str) -> Adapter:
    import yaml

    d = yaml.safe_load(text) or {}
    return Adapter(**{to: d[k] for k, to in KEYS.items() if k in d})


def load(path: str) -> Adapter:
    """An adapter from a YAML file; keys that it lacks keep their defaults, keys of other names say nothing."""
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def domain(name: str) -> Adapter:
    """The adapter of a shipped domain: retail, b2b or healthcare."""
    return RETAIL if name == "retail" else parse(files("granary.sources").joinpath("domains", f"{name}.yaml").read_text(encoding="utf-8"))
