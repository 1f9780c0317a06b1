"""Schemas of app tables, nested task records and stored rows.

Fixed values: column names are those of the tables that are read.
"""

CALENDAR_EVENT = (
    "start_ts long, end_ts long, title string, location string, description string, repeat_interval int, "
    "repeat_rule int, reminder_1_minutes int, reminder_2_minutes int, reminder_3_minutes int, reminder_1_type int, "
    "reminder_2_type int, reminder_3_type int, repeat_limit int, repetition_exceptions string, attendees string, "
    "import_id string, time_zone string, flags int, event_type int, parent_id int, last_updated long, source string, "
    "availability int, color int, type int, id long"
)
RECIPE = (
    "title string, description string, servings string, preparationTime string, source string, ingredients string, "
    "directions string, favorite int, imageName string, recipeId long"
)
EXPENSE = (
    "name string, amount long, category int, note string, created_date long, modified_date long, expense_id long"
)
PLAYLIST_INFO = "playlist_name string, media_file_name string, order_in_playlist int, duration_ms long"
TASK = (
    "title string, importance int, dueDate long, hideUntil long, created long, modified long, completed long, "
    "deleted long, notes string, recurrence string, remoteId string, _id long"
)
MAP_MARKER = (
    "marker_id string, marker_lat double, marker_lon double, marker_description string, marker_active int, "
    "marker_added long, marker_visited long, group_name string, group_key string, marker_color int, title string"
)
ACTIVITY = (
    "name string, description string, category string, activity_type string, starttime long, stoptime long, "
    "numpoints int, totaldistance double, totaltime long, movingtime long, avgspeed double, avgmovingspeed double, "
    "maxspeed double, minelevation double, maxelevation double, elevationgain double, elevationloss double, "
    "icon string, uuid binary, _id long"
)
NOTE = (
    "id string, parent_id string, title string, body string, is_todo int, todo_completed int, todo_due long, "
    "latitude double, longitude double, altitude double, source_url string, user_created_time long, "
    "user_updated_time long"
)
FOLDER = "id string, title string, parent_id string, created_time long, updated_time long"

CONDITION = "struct<operation:string,field:string,value:string>"
EXPECTATION = (
    "struct<field_transformation:struct<operation:string,field_name:string>,expected_value:string,"
    "match_type:string,tolerance:float>"
)
IR_TASK = (
    "name string, complexity int, prompt string, "
    "task_params array<struct<name:string,possible_values:array<string>>>, "
    f"relevant_state struct<exclusion_conditions:array<{CONDITION}>>, "
    f"success_criteria struct<expectations:array<{EXPECTATION}>>"
)

STEP = (
    "package string, task string, branch_path string, depth int, step_no int, before_hash string, after_hash string, "
    "action string, goal string"
)
SAMPLE = "text string, label double, metadata struct<page_id:string,action_raw:string,is_gold:boolean>"
KNOWLEDGE = "package string, idx long, attrib map<string,string>, vec array<float>, info string"
