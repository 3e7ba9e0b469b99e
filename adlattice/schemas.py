"""Schemas of the tables that arrive as files."""

# Typed: a value of the wrong JSON type reads as null on its own.
SPEC_RAW = (
    "id double, media string, placementName string, slug string, width double, height double, ratio string, "
    "ratioLabel string, category string, placementType string, sourceUrl string, sourceType string, sourceRef string, "
    "fileFormats array<string>, maxFileSizeKb double, minFileSizeKb double, colorSpace string, safeTop double, "
    "safeRight double, safeBottom double, safeLeft double, safeZoneWidth double, safeZoneHeight double, "
    "safeZoneParseStatus string, headlineMaxChars double, descriptionMaxChars double, textMaxPct double, "
    "bgTransparent boolean, isVideo boolean, notes string, needsReview boolean, lastVerified string, lastUpdated string")

EVENT = ("timestamp timestamp, jobId string, pipelineVersion string, stage string, event string, message string, "
         "metrics map<string,string>, failureCode string, artifact string")

JOB_MESSAGE = ("jobId string, psdPath string, targetMedia array<string>, specIds array<string>, resizeMode string, "
               "smartFitStrength string, focalPosition string, outputFormat string, sourceType string, psdMode string, "
               "selectedArtboardIds array<string>, objectAnalysisId string, objectReflowEnabled boolean, "
               "pipelineVersion string, pipelineType string")

LAYER_FILE = ("jobId string, psdPath string, psdSize struct<width:int,height:int>, layerCount int, layers array<struct<"
              "name:string,kind:string,role:string,depth:int,bbox:struct<left:int,top:int,right:int,bottom:int>,"
              "visible:boolean,children_count:int>>")
