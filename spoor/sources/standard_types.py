"""Definitions of standard message types, for logs that bring none. Fields, in order, of the public interface packages."""

STANDARD = {
    "builtin_interfaces/Time": "int32 sec\nuint32 nanosec",
    "builtin_interfaces/Duration": "int32 sec\nuint32 nanosec",
    "rosgraph_msgs/Clock": "builtin_interfaces/Time clock",
    "std_msgs/Header": "builtin_interfaces/Time stamp\nstring frame_id",
    "std_msgs/Empty": "",
    "std_msgs/Bool": "bool data",
    "std_msgs/String": "string data",
    "std_msgs/Int32": "int32 data",
    "std_msgs/Int64": "int64 data",
    "std_msgs/UInt8": "uint8 data",
    "std_msgs/Float32": "float32 data",
    "std_msgs/Float64": "float64 data",
    "std_msgs/ColorRGBA": "float32 r\nfloat32 g\nfloat32 b\nfloat32 a",
    "geometry_msgs/Point": "float64 x\nfloat64 y\nfloat64 z",
    "geometry_msgs/Point32": "float32 x\nfloat32 y\nfloat32 z",
    "geometry_msgs/Vector3": "float64 x\nfloat64 y\nfloat64 z",
    "geometry_msgs/Quaternion": "float64 x\nfloat64 y\nfloat64 z\nfloat64 w",
    "geometry_msgs/Pose": "Point position\nQuaternion orientation",
    "geometry_msgs/PoseStamped": "std_msgs/Header header\nPose pose",
    "geometry_msgs/PoseWithCovariance": "Pose pose\nfloat64[36] covariance",
    "geometry_msgs/Twist": "Vector3 linear\nVector3 angular",
    "geometry_msgs/TwistStamped": "std_msgs/Header header\nTwist twist",
    "geometry_msgs/TwistWithCovariance": "Twist twist\nfloat64[36] covariance",
    "geometry_msgs/Transform": "Vector3 translation\nQuaternion rotation",
    "geometry_msgs/TransformStamped": "std_msgs/Header header\nstring child_frame_id\nTransform transform",
    "tf2_msgs/TFMessage": "geometry_msgs/TransformStamped[] transforms",
    "nav_msgs/Odometry": "std_msgs/Header header\nstring child_frame_id\ngeometry_msgs/PoseWithCovariance pose\ngeometry_msgs/TwistWithCovariance twist",
    "nav_msgs/Path": "std_msgs/Header header\ngeometry_msgs/PoseStamped[] poses",
    "nav_msgs/MapMetaData": "builtin_interfaces/Time map_load_time\nfloat32 resolution\nuint32 width\nuint32 height\ngeometry_msgs/Pose origin",
    "nav_msgs/OccupancyGrid": "std_msgs/Header header\nMapMetaData info\nint8[] data",
    "sensor_msgs/Imu": "std_msgs/Header header\ngeometry_msgs/Quaternion orientation\nfloat64[9] orientation_covariance\ngeometry_msgs/Vector3 angular_velocity\nfloat64[9] angular_velocity_covariance\ngeometry_msgs/Vector3 linear_acceleration\nfloat64[9] linear_acceleration_covariance",
    "sensor_msgs/LaserScan": "std_msgs/Header header\nfloat32 angle_min\nfloat32 angle_max\nfloat32 angle_increment\nfloat32 time_increment\nfloat32 scan_time\nfloat32 range_min\nfloat32 range_max\nfloat32[] ranges\nfloat32[] intensities",
    "sensor_msgs/JointState": "std_msgs/Header header\nstring[] name\nfloat64[] position\nfloat64[] velocity\nfloat64[] effort",
    "sensor_msgs/PointField": "string name\nuint32 offset\nuint8 datatype\nuint32 count",
    "sensor_msgs/PointCloud2": "std_msgs/Header header\nuint32 height\nuint32 width\nPointField[] fields\nbool is_bigendian\nuint32 point_step\nuint32 row_step\nuint8[] data\nbool is_dense",
    "sensor_msgs/Image": "std_msgs/Header header\nuint32 height\nuint32 width\nstring encoding\nuint8 is_bigendian\nuint32 step\nuint8[] data",
    "sensor_msgs/RegionOfInterest": "uint32 x_offset\nuint32 y_offset\nuint32 height\nuint32 width\nbool do_rectify",
    "sensor_msgs/CameraInfo": "std_msgs/Header header\nuint32 height\nuint32 width\nstring distortion_model\nfloat64[] d\nfloat64[9] k\nfloat64[9] r\nfloat64[12] p\nuint32 binning_x\nuint32 binning_y\nRegionOfInterest roi",
}
