"""Fixed schemas at the boundaries."""

from pyspark.sql import types as T

FACE = T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("match_id", T.StringType())])
IMAGE_RESULTS = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("description", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("processed", T.BooleanType()), T.StructField("exif", T.MapType(T.StringType(), T.StringType())), T.StructField("face_embeddings", T.ArrayType(FACE)),
    T.StructField("face_count", T.IntegerType()), T.StructField("file_size", T.LongType()), T.StructField("creation_time", T.TimestampType()),
    T.StructField("modification_time", T.TimestampType()), T.StructField("dimensions", T.StringType()),
])
SIMILARITIES = T.StructType([
    T.StructField("image1_path", T.StringType()), T.StructField("image2_path", T.StringType()), T.StructField("similarity_score", T.DoubleType()),
    T.StructField("face_bonus", T.DoubleType()), T.StructField("face_count", T.IntegerType()),
])
GRAPH = "nodes array<struct<id:string>>, links array<struct<source:string,target:string,weight:string>>"
METRICS = "map<string,map<string,double>>"
TAGS = "map<string,struct<face_tags:array<struct<name:string,face_id:string>>,general_tags:array<string>>>"
UI_ROW = "filename string, person string, place string, period string, objects array<string>"
UI_TAGS = "array<struct<filename:string,person:string,place:string,period:string,objects:array<string>>>"
CHECKPOINT = "processed string, at timestamp"
