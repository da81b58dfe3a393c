"""The domain's tables: columns, keys, tenancy, value domains and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

TIMES = ", created_at timestamp, updated_at timestamp"


@dataclass(frozen=True)
class Reference:
    """A foreign key; on_delete is cascade, restrict or set_null."""

    column: str
    parent: str
    on_delete: str = "cascade"
    parent_key: str = "id"


@dataclass(frozen=True)
class Table:
    ddl: str
    scoped: bool = False
    key: tuple[str, ...] = ("id",)
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()

    @property
    def struct(self) -> StructType:
        return StructType.fromDDL(self.ddl)


# Columns, keys and value domains of the data model.
TABLES = {
    "tenants": Table("id long, name string, slug string, status boolean, logo_path string" + TIMES, unique=(("slug",),)),
    "organizations": Table(
        "id long, tenant_id long, parent_id long, name string, type string" + TIMES,
        scoped=True,
        references=(Reference("tenant_id", "tenants"), Reference("parent_id", "organizations", "restrict")),
        domains={"type": ("holding", "group")},
    ),
    "business_entities": Table(
        "id long, tenant_id long, type string, name string" + TIMES, scoped=True, references=(Reference("tenant_id", "tenants"),), domains={"type": ("company", "contractor")}
    ),
    "companies": Table(
        "id long, business_entity_id long, name string, company_type string" + TIMES,
        unique=(("business_entity_id",),),
        references=(Reference("business_entity_id", "business_entities", "restrict"),),
        domains={"company_type": ("individual", "corporate")},
    ),
    "contractors": Table(
        "id long, business_entity_id long, contractor_type string" + TIMES,
        unique=(("business_entity_id",),),
        references=(Reference("business_entity_id", "business_entities"),),
        domains={"contractor_type": ("permanent", "temporary")},
    ),
    "organization_companies": Table(
        "id long, organization_id long, business_entity_id long" + TIMES,
        unique=(("business_entity_id",),),
        references=(Reference("organization_id", "organizations"), Reference("business_entity_id", "business_entities")),
    ),
    "locations": Table("id long, tenant_id long, name string" + TIMES, scoped=True, references=(Reference("tenant_id", "tenants"),)),
    "operational_regions": Table(
        "id long, tenant_id long, location_id long, name string, type string, is_active boolean" + TIMES,
        scoped=True,
        references=(Reference("tenant_id", "tenants"), Reference("location_id", "locations")),
        domains={"type": ("facility", "warehouse", "business", "depot", "office", "store")},
    ),
    "location_business_entities": Table(
        "id long, location_id long, business_entity_id long, operational_region_id long, nace_code string, hazard_class string, sgk_workplace_number string" + TIMES,
        unique=(("location_id", "business_entity_id", "operational_region_id"),),
        references=(Reference("location_id", "locations"), Reference("business_entity_id", "business_entities"), Reference("operational_region_id", "operational_regions", "set_null")),
    ),
    "location_business_entity_brands": Table(
        "id long, location_business_entity_id long, brand_id long" + TIMES,
        unique=(("location_business_entity_id", "brand_id"),),
        references=(Reference("location_business_entity_id", "location_business_entities"), Reference("brand_id", "brands", "restrict")),
    ),
    "brands": Table("id long, tenant_id long, name string" + TIMES, references=(Reference("tenant_id", "tenants"),)),
    "company_brands": Table(
        "company_id long, brand_id long" + TIMES,
        key=("company_id", "brand_id"),
        unique=(("company_id", "brand_id"),),
        references=(Reference("company_id", "companies"), Reference("brand_id", "brands")),
    ),
    "users": Table("id long, name string, email string, password string, remember_token string" + TIMES, unique=(("email",),), hidden=("password", "remember_token")),
    "user_organizations": Table(
        "id long, user_id long, organization_id long" + TIMES, unique=(("user_id", "organization_id"),), references=(Reference("organization_id", "organizations"),)
    ),
    "roles": Table("id long, name string, guard_name string" + TIMES),
    "model_has_roles": Table("role_id long, model_type string, model_id long", key=("role_id", "model_type", "model_id"), references=(Reference("role_id", "roles"),)),
}
