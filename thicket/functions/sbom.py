"""Bills of materials: SPDX 2.3 and CycloneDX 1.5 documents of packages as JSON columns.

The time of a document and its serial number are parameters, so that the same
package always has the same document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOL, TOOL_VERSION, VENDOR = "thicket", "1.0", "thicket"


def spdx_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}.-]", "-")


def spdx_ref(name: Column) -> Column:
    return F.concat(F.lit("SPDXRef-Package-"), spdx_id(name))


def spdx(project: Column, version: Column, packages: Column, dependencies: Column, created: str, serial: Column) -> Column:
    """packages: array of (id, name, version, ecosystem, licence, purl, sha256); dependencies: array of (source, target). Both sorted."""
    package = lambda p: F.struct(
        spdx_ref(p["id"]).alias("SPDXID"),
        p["name"].alias("name"),
        p["version"].alias("versionInfo"),
        F.concat(F.lit("https://registry."), F.lower(p["ecosystem"]), F.lit(".org/"), p["name"]).alias("downloadLocation"),
        F.lit(False).alias("filesAnalyzed"),
        F.when(p["sha256"].isNotNull(), F.array(F.struct(F.lit("SHA256").alias("algorithm"), p["sha256"].alias("checksumValue")))).alias("checksums"),
        p["licence"].alias("licenseConcluded"),
        p["licence"].alias("licenseDeclared"),
        F.lit("NOASSERTION").alias("copyrightText"),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), p["purl"].alias("referenceLocator"))).alias("externalRefs"),
        F.lit("LIBRARY").alias("primaryPackagePurpose"),
    )
    relation = lambda a, kind, b: F.struct(a.alias("spdxElementId"), F.lit(kind).alias("relationshipType"), b.alias("relatedSpdxElement"))
    described = F.array(relation(F.lit("SPDXRef-DOCUMENT"), "DESCRIBES", spdx_ref(project)))
    needed = F.transform(dependencies, lambda d: relation(spdx_ref(d["source"]), "DEPENDS_ON", spdx_ref(d["target"])))
    return F.to_json(
        F.struct(
            F.lit("SPDX-2.3").alias("spdxVersion"),
            F.lit("CC0-1.0").alias("dataLicense"),
            F.lit("SPDXRef-DOCUMENT").alias("SPDXID"),
            F.concat(project, F.lit(" SBOM")).alias("name"),
            F.concat(F.lit("https://sbom.invalid/"), F.lower(F.replace(project, F.lit(" "), F.lit("-"))), F.lit("-"), version, F.lit("-"), serial).alias("documentNamespace"),
            F.struct(F.lit(created).alias("created"), F.array(F.lit(f"Tool: {TOOL}-{TOOL_VERSION}"), F.lit(f"Organization: {VENDOR}")).alias("creators"), F.lit("3.19").alias("licenseListVersion")).alias("creationInfo"),
            F.transform(packages, package).alias("packages"),
            F.concat(described, needed).alias("relationships"),
        )
    )


def cyclonedx(project: Column, version: Column, packages: Column, dependencies: Column, vulnerabilities: Column, created: str, serial: Column) -> Column:
    """packages as above with is_direct; dependencies: array of (source, targets); vulnerabilities: array of (id, severity, score, affected)."""
    component = lambda p: F.struct(
        F.lit("library").alias("type"),
        p["id"].alias("bom-ref"),
        p["name"].alias("name"),
        p["version"].alias("version"),
        F.when(p["is_direct"], "required").otherwise("optional").alias("scope"),
        F.when(p["sha256"].isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), p["sha256"].alias("content")))).alias("hashes"),
        F.when(p["licence"].isNotNull(), F.array(F.struct(p["licence"].alias("expression")))).alias("licenses"),
        p["purl"].alias("purl"),
        F.array(F.struct(F.lit("ecosystem").alias("name"), p["ecosystem"].alias("value")), F.struct(F.lit("dependency:direct").alias("name"), p["is_direct"].cast("string").alias("value"))).alias("properties"),
    )
    finding = lambda v: F.struct(
        v["id"].alias("bom-ref"),
        v["id"].alias("id"),
        F.when(v["score"].isNotNull(), F.array(F.struct(v["score"].alias("score"), v["severity"].alias("severity"), F.lit("CVSSv3").alias("method")))).alias("ratings"),
        F.array(F.struct(v["affected"].alias("ref"))).alias("affects"),
    )
    tool = F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit(TOOL).alias("name"), F.lit(TOOL_VERSION).alias("version"))).alias("components"))
    return F.to_json(
        F.struct(
            F.lit("CycloneDX").alias("bomFormat"),
            F.lit("1.5").alias("specVersion"),
            F.concat(F.lit("urn:uuid:"), serial).alias("serialNumber"),
            F.lit(1).alias("version"),
            F.struct(F.lit(created).alias("timestamp"), tool.alias("tools"), F.struct(F.lit("application").alias("type"), project.alias("bom-ref"), project.alias("name"), version.alias("version")).alias("component")).alias("metadata"),
            F.transform(packages, component).alias("components"),
            F.transform(dependencies, lambda d: F.struct(d["source"].alias("ref"), d["targets"].alias("dependsOn"))).alias("dependencies"),
            F.transform(vulnerabilities, finding).alias("vulnerabilities"),
            F.array(F.struct(F.lit("complete").alias("aggregate"))).alias("compositions"),
        )
    )
