"""Policy for the tags of medical images, as rewrites of a map column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import redact

BLANK = frozenset(
    f"Patient{x}" for x in ("Address", "BirthDate", "BirthName", "BirthTime", "ID", "MotherBirthName", "Name", "TelephoneNumbers")
) | frozenset(
    "AccessionNumber InstitutionAddress InstitutionName InstitutionalDepartmentName MedicalRecordLocator NameOfPhysiciansReadingStudy OperatorsName OtherPatientIDs "
    "OtherPatientIDsSequence OtherPatientNames PerformingPhysicianName PhysiciansOfRecord ReferringPhysicianAddress ReferringPhysicianName "
    "ReferringPhysicianTelephoneNumbers ResponsibleOrganization ResponsiblePerson StationName".split()
)
DATES = frozenset(f"{x}Date" for x in ("Acquisition", "Content", "InstanceCreation", "PerformedProcedureStepEnd", "PerformedProcedureStepStart", "Series", "Study"))
UIDS = frozenset(f"{x}InstanceUID" for x in ("SOP", "Series", "Study"))
FREE_TEXT = frozenset(
    "AdditionalPatientHistory AdmittingDiagnosesDescription ClinicalTrialProtocolName ClinicalTrialSiteName ImageComments PatientComments PerformedProcedureStepDescription "
    "ReasonForTheRequestedProcedure RequestedProcedureDescription SeriesDescription StudyDescription".split()
)


def new_uid(uid: Column, salt: str = "") -> Column:
    """A keyed UID, so the images of one study stay one study."""
    h = F.sha2(F.concat(F.lit(salt), uid), 256)
    return F.concat(F.lit("2.25."), F.conv(F.substring(h, 1, 15), 16, 10), F.lpad(F.conv(F.substring(h, 16, 13), 16, 10), 16, "0"))


def anonymise_tag(k: Column, v: Column, days: Column | int, salt: str = "") -> Column:
    """The new value of tag `k`: identifying ones emptied, dates moved, UIDs
    renewed, free text redacted; others as they are."""
    has = F.trim(v) != ""
    return (
        F.when(k.isin(*sorted(BLANK)), F.lit("")).when(has & k.isin(*sorted(DATES)), dates.shift_tag(v, days))
        .when(has & k.isin(*sorted(UIDS)), new_uid(v, salt)).when(has & k.isin(*sorted(FREE_TEXT)), redact(v)).otherwise(v)
    )


def anonymise_tags(tags: Column, days: Column | int, salt: str = "") -> Column:
    """anonymise_tag() on a map of tags."""
    return F.transform_values(tags, lambda k, v: anonymise_tag(k, v, days, salt))


def redact_everywhere(tags: Column, text: Column) -> Column:
    """A text found in one tag starred in every tag that holds it."""
    return F.transform_values(tags, lambda k, v: F.when(F.trim(text) != "", F.replace(v, text, F.repeat(F.lit("*"), F.length(text)))).otherwise(v))


def is_multiframe(shape: Column, tags: Column) -> Column:
    """Four axes, or three with more than one frame declared."""
    frames = F.coalesce(F.try_element_at(tags, F.lit("NumberOfFrames")).cast("int"), F.lit(1))
    return (F.size(shape) == 4) | ((F.size(shape) == 3) & (frames > 1))


def info(shape: Column, tags: Column) -> Column:
    """What an image is: frames, height and width, colour, modality, bits."""
    video, tag = is_multiframe(shape, tags), lambda k: F.try_element_at(tags, F.lit(k))
    at = F.when(video, 1).otherwise(0)
    colour = F.coalesce(tag("SamplesPerPixel").cast("int"), F.lit(1)) >= 3
    return F.struct(
        video.alias("is_video"), F.when(video, shape[0]).otherwise(1).alias("frame_count"), F.get(shape, at).alias("height"), F.get(shape, at + 1).alias("width"),
        colour.alias("is_color"), tag("Modality").alias("modality"), tag("BitsStored").cast("int").alias("bits_stored"),
    )
